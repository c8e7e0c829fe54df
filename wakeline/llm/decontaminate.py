"""Benchmark passages in documents: Wu-Manber search for many word sequences.

Patterns are the windows of benchmark items: 13 consecutive words, or a whole item that is shorter.
All patterns of one length form a table set. A block is a pair of neighbouring words. The shift
table says how far the search may jump when a block ends a window, the smallest distance of that
block from any pattern's end, and the whole window length when no pattern has the block. Only a
shift of zero opens the suffix bucket of that block, and its patterns are compared word by word.

The tables go to the executors as a broadcast of bounded size. Patterns are dealt into parts of at
most ``PART_BYTES``; normally there is one. With more, each part is one more pass over the
documents, whose result is stored before the next.

Defined results: null and empty texts have no words and no hits; an item without words has no
windows and matches nothing; repeated items each count; items without an identifier are one item whose
windows hit as any other's, listed last as null; repeated documents each get their row; empty
tables give no rows or no hits; clashing column names do not matter, inputs are selected by name.
"""

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.storage import stored
from wakeline.llm.words import blocks, in_batches, utf8

WINDOW = 13
PART_BYTES = 16 << 20

#: Bytes to word letters: A-Z lower-cased, 0-9, a-z and all of 128 and above kept, others separate.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(LETTERS).split()


class Patterns:
    """Wu-Manber tables of patterns of one length, in words."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list]):
        self.length = length
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.buckets = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - self.block : end]
                self.shift[key] = min(self.shift.get(key, self.jump), length - end)
            self.buckets[pattern[length - self.block :]].append((list(pattern), items))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, list]]:
        """(start, items) of every occurrence."""
        m, b, jump, n = self.length, self.block, self.jump, len(text)
        shift, buckets = self.shift.get, self.buckets
        at = m - 1
        while at < n:
            key = tuple(text[at - b + 1 : at + 1])
            step = shift(key, jump)
            if step:
                at += step
                continue
            start = at - m + 1
            for pattern, items in buckets[key]:
                if pattern[0] == text[start] and pattern == text[start : at + 1]:
                    yield start, items
            at += 1


def tables(windows: list) -> list[Patterns]:
    """Tables by length from rows of (item, words joined by a space)."""
    by_length: dict = defaultdict(lambda: defaultdict(list))
    for item, joined in windows:
        pattern = tuple(joined.encode("utf-8", "surrogatepass").split(b" "))
        by_length[len(pattern)][pattern].append(item)
    return [Patterns(n, p) for n, p in sorted(by_length.items())]


def item_windows(items: DataFrame, id_column: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item, window) rows; the item as text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1):
            out = []
            for item, raw in zip(batch.column(0).to_pylist(), utf8(batch.column(1))):
                found = [w.decode("utf-8") for w in words(raw)]
                if found:
                    starts = range(max(1, len(found) - window + 1))
                    out += [(item, " ".join(found[i : i + window])) for i in starts]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], ["item", "words"])

    rows = items.select(F.col(id_column).cast("string").alias("item"), F.col(text).alias("text"))
    return in_batches(rows, cut, "item string, words string").distinct()


def contamination(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, spans (start, end in words) and items (text, sorted)."""
    marked = mark(docs.select(F.col(id_column), F.col(text).alias("text")), items, "text", item_id, item_text, window)
    return marked.drop("text")


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW) -> DataFrame:
    """The documents with n_words, n_hit, spans and items added."""
    patterns = stored(item_windows(items, item_id, item_text, window), "windows")
    weight = patterns.agg(F.coalesce(F.sum(F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0))), F.lit(0))).first()[0]
    parts = max(1, -(-weight // PART_BYTES))
    fields = ("n_words", "n_hit", "spans", "items")
    kept = docs.drop(*fields)
    out = kept.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                      F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for part in range(parts):
        own = patterns.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part) if parts > 1 else patterns
        # Bounded: one part of the benchmark, PART_BYTES of words.
        rows = docs.sparkSession.sparkContext.broadcast([(r.item, r.words) for r in own.toLocalIterator()])
        out = _searched(out, rows, out.columns.index(text), len(kept.columns))
        if part < parts - 1:
            out = stored(out, "hits")
    return out


def _searched(docs: DataFrame, patterns, at: int, first: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables(patterns.value)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in blocks(batches, at):
            out = []
            for raw, spans, items in zip(utf8(batch.column(at)), batch.column(first + 2).to_pylist(), batch.column(first + 3).to_pylist()):
                text = words(raw)
                found = {*items}
                ranges = [(s["start"], s["end"]) for s in spans]
                for table in known:
                    for start, owners in table.find(text):
                        found.update(owners)
                        ranges.append((start, start + table.length))
                ranges = united(ranges)
                out.append((len(text), sum(b - a for a, b in ranges), [{"start": a, "end": b} for a, b in ranges], sorted(found, key=lambda i: (i is None, i or ""))))
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), spans_type, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], *columns], batch.schema.names)

    return in_batches(docs, run, docs.schema)


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, sorted."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(ranges)):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
