"""Words, word hashes and runs of words, computed on whole blocks of texts with numpy.

A block is a list of texts of bounded total size. Its words get 64-bit hashes once per distinct
word; everything after that is array arithmetic. Hashes do not depend on process or machine.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

BLOCK_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
ROLL = np.uint64(0x9E3779B97F4A7C55)


def in_batches(df: DataFrame, work, schema) -> DataFrame:
    """mapInArrow with small batches: what a Python worker holds at once follows BATCH_BYTES.

    The limit is a session setting without a per-operator form; a smaller one of the session stays.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:  # another unit is a larger one
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def blocks(batches: Iterator[pa.RecordBatch], text: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice hold about ``limit`` bytes, one row at least."""
    for batch in batches:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), dtype=np.int64)
        begin, size = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if i > begin and size + n > limit:
                yield batch.slice(begin, i - begin)
                begin, size = i, 0
            size += n
        if begin < batch.num_rows:
            yield batch.slice(begin)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


class _Hashes(dict):
    """Word to position in the order of first sight, with the hashes alongside."""

    def __init__(self):
        self.values_ = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.values_.append(xxhash.xxh3_64_intdigest(word))
        return n


def hashed(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of all texts, offsets of the texts: one more than there are texts)."""
    table = _Hashes()
    at = table.__getitem__
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    ids = np.fromiter((at(w) for t in texts for w in t), np.int64, int(offsets[-1]))
    return np.array(table.values_, np.uint64)[ids] if len(ids) else np.empty(0, np.uint64), offsets


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def step(n: int) -> np.uint64:
    """The n-th member of a sequence of well spread 64-bit numbers."""
    return np.uint64(int(GOLDEN) * int(n) & (2**64 - 1))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the run of ``length`` words that starts at each position, whatever text it crosses."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, length):
        total *= ROLL
        total += hashes[i : n + i]
    return mixed(total)


def run_starts(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, text number) of every run of ``length`` words that lies inside one text."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    before = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(int(counts.sum())) - np.repeat(before - offsets[:-1], counts), owner


def shingles(hashes: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, text number): runs of ``length`` words; a shorter text, if not empty, is one shingle."""
    at, owner = run_starts(offsets, length)
    values = runs(hashes, length)[at] if len(at) else np.empty(0, np.uint64)
    sizes = np.diff(offsets)
    short = np.flatnonzero((sizes > 0) & (sizes < length))
    if len(short):
        extra = [int(mixed(runs(hashes[offsets[i] : offsets[i + 1]], int(sizes[i])) + step(sizes[i]))[0]) for i in short]
        values = np.concatenate((values, np.array(extra, np.uint64)))
        owner = np.concatenate((owner, short))
    return values, owner


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
