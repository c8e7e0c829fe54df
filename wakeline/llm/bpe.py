"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer file.

The file gives merges in order of rank. A word is a list of symbols; beside it stands the
contiguous array of the ranks of adjacent symbols. The smallest rank, leftmost on ties, is looked
for by scanning, its right boundary is deleted, and the two ranks that touch the merged symbol are
refreshed. Scanning suits short words; a word beyond ``LONG_WORD`` symbols keeps its pairs in a
heap with the same order of merges, so time stays n log n on texts without spaces.

Text model (that of the file): NFC, lower case, white space separates and is dropped, special
tokens are recognised in the raw text. Null and empty texts have no tokens. Equal texts, repeated
rows and ties give equal results; other columns pass through, one named like an output is replaced.
"""

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wakeline.llm.words import blocks, in_batches

LONG_WORD = 64
#: Entries of one cache generation; a worker holds two of words and two of stretches, tokens as packed 32-bit numbers.
CACHED_WORDS = 90_000
NO_RANK = 1 << 60
#: A pair of symbols as one number: left << SHIFT | right.
SHIFT = 24
#: The pre-tokenizer's pattern (a fixed value of the file format).
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: Separators that str.split() knows beyond the White_Space property.
CONTROLS = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\p{White_Space}+")


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class Generations:
    """A cache that forgets: what was not asked for while a generation filled up goes with the one before."""

    def __init__(self, compute):
        self.compute, self.young, self.old = compute, {}, {}

    def load(self, keys) -> dict:
        """A dictionary that holds all the keys, as it stands until the next call."""
        if len(self.young) > CACHED_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        for key in set(keys).difference(young):
            found = old.get(key)
            young[key] = self.compute(key) if found is None else found
        return young


class Vocabulary:
    """Symbols as token ids; ranks by pair of symbols, merged symbols by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(model["merges"]):
            merged = self.ids.get(a + b, -1)
            self.merged.append(merged)
            if a in self.ids and b in self.ids and merged >= 0:
                self.ranks[self.ids[a] << SHIFT | self.ids[b]] = rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.letters = byte_letters()
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.inner = [self.ids[x] for x in self.letters]
        self.last = [self.ids[x + self.end] for x in self.letters]
        self.words = Generations(self.word)
        self.stretches = Generations(self.stretch)

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        parts = [self.inner[b] for b in raw]
        parts[-1] = self.last[raw[-1]]
        return parts

    def word(self, word: str) -> bytes:
        """Packed tokens of a word."""
        return array("i", self.merge(self.symbols(word))).tobytes()

    def merge(self, parts: list[int]) -> list[int]:
        """All merges of one word, lowest rank first, leftmost on ties."""
        if len(parts) > LONG_WORD:
            return self._merge_long(parts)
        find, merged = self.ranks.get, self.merged
        pairs = [find(a << SHIFT | b, NO_RANK) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = min(pairs)
            if best == NO_RANK:
                break
            i = pairs.index(best)
            new = parts[i] = merged[best]
            del parts[i + 1], pairs[i]
            if i:
                pairs[i - 1] = find(parts[i - 1] << SHIFT | new, NO_RANK)
            if i < len(pairs):
                pairs[i] = find(new << SHIFT | parts[i + 1], NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        n, find, merged = len(parts), self.ranks.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := find(parts[i] << SHIFT | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or find(parts[i] << SHIFT | parts[j]) != rank:
                continue
            new = parts[i] = merged[rank]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := find(new << SHIFT | parts[after[i]])) is not None:
                    heapq.heappush(heap, (m, i))
            if before[i] >= 0 and (m := find(parts[before[i]] << SHIFT | new)) is not None:
                heapq.heappush(heap, (m, before[i]))
        return [p for p in parts if p is not None]

    def stretch(self, text: str) -> bytes:
        """Packed tokens of a stretch without white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Letter by letter: a sigma that ends a word is no special case here.
        text = "".join(c.lower() for c in text) if "\u03a3" in text else text.lower()
        pieces = [text] if text.isascii() and text.isalpha() else PIECE.findall(text)
        words = self.words.load(pieces)
        if len(pieces) == 1:
            return words[pieces[0]]
        return b"".join(map(words.__getitem__, pieces))

    def plain(self, text: str) -> array:
        """Tokens of a text without special tokens; stretches seen before come from the cache."""
        stretches = SPACE.split(text) if CONTROLS.search(text) else text.split()
        return array("i", b"".join(map(self.stretches.load(stretches).__getitem__, stretches)))

    def encode(self, text: str) -> array:
        out, at = array("i"), 0
        for m in self.specials.finditer(text) if "<|" in text or not self._marked() else ():
            out += self.plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self.plain(text[at:])

    def _marked(self) -> bool:
        return all(s.startswith("<|") for s in self.special)

    def decode(self, ids) -> str:
        """Tokens joined by one space: the file names no decoder, so word ends stay visible."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add the token ids of ``text`` as an array of int, and if named the text decoded from them.

    ``tokenizer`` is a file that every worker has.
    """
    targets = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        targets.append(T.StructField(decoded, T.StringType(), False))

    def work(known: Vocabulary, column: pa.Array) -> list[pa.Array]:
        rows = [known.encode(t or "") for t in column.to_pylist()]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        flat = np.concatenate([np.frombuffer(r, np.int32) for r in rows])
        out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
        return [*out, pa.array([known.decode(r) for r in rows], pa.string())] if decoded else out

    return _mapped(df, tokenizer, text, targets, work)


def decode(df: DataFrame, tokenizer: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add the text of an array of token ids; null and empty arrays give the empty text."""

    def work(known: Vocabulary, column: pa.Array) -> list[pa.Array]:
        return [pa.array([known.decode(r or ()) for r in column.to_pylist()], pa.string())]

    return _mapped(df, tokenizer, ids, [T.StructField(text, T.StringType(), False)], work)


def _mapped(df: DataFrame, tokenizer: str, source: str, targets: list[T.StructField], work) -> DataFrame:
    names = [t.name for t in targets]
    if source in names:
        raise ValueError("input and output column must differ")
    kept = df.drop(*names)
    at = kept.columns.index(source)
    texts = isinstance(kept.schema[source].dataType, T.StringType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer)
        for part in blocks(batches, at) if texts else batches:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([*part.columns, *work(known, part.column(at))], [*part.schema.names, *names])

    return in_batches(kept, run, T.StructType([*kept.schema.fields, *targets]))
