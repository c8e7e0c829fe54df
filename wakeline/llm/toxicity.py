"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding makes disguised spellings equal: compatibility forms, accents that only decorate, letters
of other scripts that look Latin, and digits or signs that stand for letters between letters.
The lexicon is learnt: each folded word of a labelled training document counts once, whole and by
its beginnings of 3 to 7 letters, and gets the smoothed log-odds of the toxic label as weight.
Phrases of a lexicon word and a neighbour that speak against the label become exceptions: an
occurrence inside one counts the phrase's own weight. The sum of weights is normalised by the
logarithm of the length, and a logistic curve fitted on the training rows turns it into 0..1.

Two parameters bound the model, so that it may be broadcast: training takes at most ``max_labelled``
labelled rows (the smallest hashes of the identifier), and the lexicon keeps at most
``max_entries`` of those with the strongest evidence. All documents are scored, over whole texts.

Defined results: null and empty texts score like a text without any match; repeated and tied rows
score alike; without usable labels every score is the prior 0.5 below the threshold, i.e. 0;
other columns are neither read nor kept.
"""

import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.llm.storage import stored
from wakeline.llm.words import blocks, in_batches

#: Letters of other scripts that look like a Latin letter.
HOMOGLYPHS = dict(zip(
    "абвгдеёзіїјкмнорстухѕһԁɡαβεηικνορτυχωı",
    "abbrdeeeiijkmhopctyxshdgabenikvoptuxwi",
))
#: Digits and signs that stand for a letter between letters.
SUBSTITUTES = dict(zip("013457@$!|+", "oieastasiit"))
GLYPHS = str.maketrans(HOMOGLYPHS)
DIGITS = str.maketrans(SUBSTITUTES)
INVISIBLE = regex.compile(r"[\p{Cf}\p{Mn}]+")
WORD = regex.compile(r"[\p{L}\p{N}@$!|+]+")
LATIN = regex.compile(r"[a-z]")
SIGNS = regex.compile(r"[013457@$!|+]")
PREFIXES = range(3, 8)


def folded_word(word: str) -> str:
    """A lower-case word with look-alikes replaced; signs only where letters stand beside them."""
    if not word.isascii():
        word = INVISIBLE.sub("", unicodedata.normalize("NFKD", word)).lower().translate(GLYPHS)
    if SIGNS.search(word):
        bare = word.rstrip("!|+$@")
        if LATIN.search(bare):
            return bare.translate(DIGITS)
        return bare
    return word


def folded(text: str) -> list[str]:
    """The folded words of a text, in order."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    words = WORD.findall(text.lower())
    return [w for w in map(_FOLDS.__getitem__, words) if w]


class _Folds(dict):
    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        self[word] = out = folded_word(word)
        return out


_FOLDS = _Folds()


def terms(words: list[str]) -> set[str]:
    """What a document counts for: words between blanks, and their beginnings behind a blank."""
    distinct = set(words)
    return {f" {w} " for w in distinct} | {f" {w[:n]}" for w in distinct for n in PREFIXES if len(w) > n}


def phrases(words: list[str], lexicon) -> set[str]:
    """Neighbouring words of which one is in the lexicon."""
    return {f" {a} {b} " for a, b in zip(words, words[1:]) if hit(a, lexicon) or hit(b, lexicon)}


def hit(word: str, lexicon) -> bool:
    return f" {word} " in lexicon or any(f" {word[:n]}" in lexicon for n in PREFIXES if len(word) > n)


class Scorer:
    """Aho-Corasick automaton over ' word word ' with the weights of lexicon and exceptions."""

    def __init__(self, lexicon: dict[str, float], exceptions: dict[str, float], slope: float, offset: float):
        self.slope, self.offset = slope, offset
        self.machine = ahocorasick.Automaton()
        for term, weight in lexicon.items():
            self.machine.add_word(term, (term, weight, False))
        for phrase, weight in exceptions.items():
            self.machine.add_word(phrase, (phrase, weight, True))
        if len(self.machine):
            self.machine.make_automaton()

    def matches(self, words: list[str]) -> list[tuple[int, str, float]]:
        """(start, term, weight) in the joined text: the longest term of each start, phrases first."""
        if not len(self.machine):
            return []
        spans, longest = [], {}
        for last, (term, weight, phrase) in self.machine.iter(f" {' '.join(words)} "):
            start = last - len(term) + 1
            if phrase:
                spans.append((start, term, weight))
            elif start not in longest or len(term) > len(longest[start][0]):
                longest[start] = (term, weight)
        covered = {p for a, t, _ in spans for p in range(a, a + len(t) - 1)}
        return spans + [(s, t, w) for s, (t, w) in longest.items() if s not in covered]

    def raw(self, words: list[str]) -> float:
        """Weights of the distinct matches, so that a repeated line speaks once, by log length."""
        found = {t: w for _, t, w in self.matches(words)}
        return sum(found.values()) / math.log(math.e + len(words) / 100) if found else 0.0

    def score(self, words: list[str]) -> float:
        x = self.slope * self.raw(words) + self.offset
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def _counted(rows: DataFrame, make) -> DataFrame:
    """(term, toxic, clean): labelled folded documents with each term, pre-aggregated by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 0):
            counts: dict[str, list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for term in make(text.split(" ") if text else []):
                    counts.setdefault(term, [0, 0])[label] += 1
            columns = [pa.array(list(counts), pa.string()), *(pa.array([c[i] for c in counts.values()], pa.int64()) for i in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])

    found = in_batches(rows, run, "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _folded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, 0):
        texts = [" ".join(folded(t or "")) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(1)], ["text", "label"])


def learn(labelled: DataFrame, max_entries: int = 20_000, min_rows: int = 3) -> Scorer:
    """Lexicon, exceptions and curve from rows of (text, label 0 or 1)."""
    rows = labelled.where("label in (0, 1)").select("text", F.col("label").cast("int").alias("label"))
    rows = stored(in_batches(rows, _folded_rows, "text string, label int"), "labelled")
    total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("toxic"), F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).alias("clean")).first()
    if not total.toxic or not total.clean:
        return Scorer({}, {}, 1.0, -20.0)
    odds = F.log((F.col("toxic") + 0.5) / (total.toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (total.clean + 1.0))
    # Evidence: how far the toxic count lies above what the prior gives, in standard deviations.
    prior = total.toxic / (total.toxic + total.clean)
    seen = F.col("toxic") + F.col("clean")
    strength = (F.col("toxic") - seen * prior) / F.sqrt(seen * (prior * (1 - prior)))
    entries = _counted(rows, terms).where(F.col("toxic") >= min_rows).select("term", odds.alias("weight"), strength.alias("strength"))
    entries = entries.where("weight > 3 and strength > 7").orderBy(F.desc("strength"), "term").limit(max_entries)
    lexicon = {r.term: r.weight for r in entries.collect()}  # bounded by max_entries
    known = rows.sparkSession.sparkContext.broadcast(frozenset(lexicon))
    against = _counted(rows, lambda words: phrases(words, known.value)).where(F.col("clean") >= min_rows).select("term", odds.alias("weight"), "clean")
    against = against.where("weight < 0").orderBy(F.desc("clean"), "term").limit(max_entries)
    exceptions = {r.term: r.weight for r in against.collect()}  # bounded by max_entries
    return _fitted(rows, lexicon, exceptions)


def _fitted(rows: DataFrame, lexicon: dict, exceptions: dict) -> Scorer:
    """The logistic curve over raw scores, by Newton steps on counts of rounded raw scores."""
    scorer = Scorer(lexicon, exceptions, 1.0, 0.0)
    pieces = rows.sparkSession.sparkContext.broadcast((lexicon, exceptions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*pieces.value, 1.0, 0.0)
        for batch in blocks(batches, 0):
            words = [t.split(" ") if t else [] for t in batch.column(0).to_pylist()]
            raw = [max(-50.0, min(50.0, round(own.raw(w), 1))) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array(raw, pa.float64()), batch.column(1)], ["raw", "label"])

    # At most 1001 rounded scores of two labels.
    counts = in_batches(rows, run, "raw double, label int").groupBy("raw", "label").count().collect()
    x, y, n = (np.array([r[i] for r in counts], float) for i in range(3))
    design = np.stack([x, np.ones_like(x)], 1)
    theta, ridge = np.zeros(2), np.array([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - ridge * theta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        theta = theta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    scorer.slope, scorer.offset = float(theta[0]), float(theta[1])
    return scorer


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = 40_000) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fifth, at most ``max_labelled``."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    marked = marked.where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.join(chosen, "doc_id").select("text", "label")


def held_out(doc_id):
    """The fifth of documents that never trains: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, scorer: Scorer, text: str = "text", output: str = "score") -> DataFrame:
    """The documents with a score between 0 and 1 added."""
    kept = docs.drop(output) if output != text else docs
    at = kept.columns.index(text)
    lexicon = {t: v[1] for t, v in scorer.machine.items() if not v[2]}
    exceptions = {t: v[1] for t, v in scorer.machine.items() if v[2]}
    pieces = docs.sparkSession.sparkContext.broadcast((lexicon, exceptions, scorer.slope, scorer.offset))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer(*pieces.value)
        for batch in blocks(batches, at):
            scores = [own.score(folded(t or "")) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, output])

    return in_batches(kept, run, T.StructType([*kept.schema.fields, T.StructField(output, T.DoubleType(), False)]))
