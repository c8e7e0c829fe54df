"""Passages that repeat across documents, found by level-wise doubling.

A window is a run of ``min_words`` words. The search starts with runs of about half, quarter, ... that
length. At each level only runs whose shorter runs repeat are looked at in twice the length, until the
window length itself; windows alone at a shorter level are out. Below the last level a window asks only
for the shorter run with the smallest hash inside it: equal windows choose equal runs, and if that
one does not repeat, the window cannot.

Texts are packed into chunks of a few megabytes, one row each. A chunk sends the sorted distinct hashes of its
runs, cut into buckets of the hash range, so that a run met a thousand times in a chunk travels
once. The bucket answers with one bit per hash. At shorter levels the bit says that another chunk has the run
too; at the last level that a smaller document elsewhere has the window. What repeats inside a
chunk the chunk sees itself. Hot passages therefore cost one hash per chunk, and no group is collected.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows with
the same identifier are one document here and do not remove words from each other; a null
identifier counts as larger than any other; an empty table gives no rows; clashing column names do not matter.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.storage import stored
from wakeline.llm.words import blocks, hashed, in_batches, run_starts, runs, utf8

SHORTEST = 6
#: Stands for null in chunks that are marked as having no identifiers.
NULL_ID = np.int64(2**63 - 1)
BUCKET_WINDOWS = 2_000_000
CHUNK = "chunk long, windows long, nulls boolean, payload binary"


def levels(min_words: int) -> list[int]:
    """Run lengths, each at most twice the one before; the last is the window."""
    found = [min_words]
    while found[0] >= 2 * SHORTEST - 1:
        found.insert(0, (found[0] + 1) // 2)
    return found


def packed(ids: np.ndarray, texts: list[bytes]) -> bytes:
    lengths = np.array([len(t) for t in texts], np.int64)
    head = np.array([len(texts)], np.int64).tobytes() + ids.tobytes() + lengths.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(texts))


def unpacked(payload) -> tuple[np.ndarray, list[list[bytes]]]:
    """Document ids and their words."""
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, lengths = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    ends = 8 + 16 * n + np.cumsum(lengths)
    return ids, [raw[e - m : e].split() for e, m in zip(ends.tolist(), lengths.tolist())]


def chunks(docs: DataFrame, id_column: str, text: str, min_words: int) -> DataFrame:
    """Chunk rows (chunk, windows, payload); the number of a chunk is its task and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in blocks(batches, 1):
            known = pa.compute.is_valid(batch.column(0))
            # Rows without an identifier are chunks of their own: no number stands for null.
            for nulls, part in ((False, batch.filter(known)), (True, batch.filter(pa.compute.invert(known)))):
                if not part.num_rows:
                    continue
                ids = np.array([NULL_ID if nulls else i for i in part.column(0).to_pylist()], np.int64)
                texts = utf8(part.column(1))
                # An upper bound, to choose the number of buckets.
                windows = sum(max(0, len(t) // 2 + 1) for t in texts)
                columns = [pa.array([number], pa.int64()), pa.array([windows], pa.int64()), pa.array([nulls]), pa.array([packed(ids, texts)], pa.binary())]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "windows", "nulls", "payload"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return in_batches(rows, run, CHUNK)


class Chunk:
    """A chunk's windows and which of them are still candidates after the levels answered so far."""

    def __init__(self, payload, min_words: int, buckets: int):
        self.buckets = buckets
        self.window = min_words
        self.ids, self.texts = unpacked(payload)
        self.hashes, self.offsets = hashed(self.texts)
        self.start, self.owner = run_starts(self.offsets, min_words)

    def anchors(self, length: int) -> np.ndarray:
        """For each candidate window the hash of its chosen run of ``length`` words."""
        values = runs(self.hashes, length)
        if length == self.window or not len(self.start):
            return values[self.start] if len(self.start) else np.empty(0, np.uint64)
        views = sliding_window_view(values, self.window - length + 1)
        return views[self.start].min(axis=1)

    def request(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct hashes, of each the smallest and largest document, window to hash)."""
        values = self.anchors(length)
        keys, inverse = np.unique(values, return_inverse=True)
        document = self.ids[self.owner]
        low, high = np.full(len(keys), NULL_ID), np.full(len(keys), -(2**63))
        np.minimum.at(low, inverse, document)
        np.maximum.at(high, inverse, document)
        return keys, low, high, inverse

    def narrowed(self, length: int, bits: np.ndarray) -> None:
        """Keep candidates whose run repeats, in another chunk (bits) or in a second document here."""
        keys, low, high, inverse = self.request(length)
        stays = (bits[: len(keys)] | (low < high))[inverse]
        self.start, self.owner = self.start[stays], self.owner[stays]

    def removed(self, bits: np.ndarray) -> np.ndarray:
        """Mark of every word covered by a window that a smaller document has."""
        keys, low, _, inverse = self.request(self.window)
        taken = bits[: len(keys)][inverse] | (self.ids[self.owner] > low[inverse])
        change = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(change, self.start[taken], 1)
        np.add.at(change, self.start[taken] + self.window, -1)
        return np.cumsum(change)[:-1] > 0


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's share of the sorted hashes begins."""
    edges = [(b << 64) // buckets for b in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)])).astype(np.int64)


def squeezed(numbers: np.ndarray) -> bytes:
    """Sorted or repetitive 64-bit numbers: differences by byte planes, compressed."""
    steps = np.diff(numbers.view(np.uint64), prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def restored(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _requests(rows: DataFrame, names: list[str], level: int, lengths: list[int], buckets: int) -> DataFrame:
    last = level == len(lengths) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _replayed(row, lengths, level, buckets)
                keys, low, _, _ = chunk.request(lengths[level])
                at = cuts(keys, buckets).tolist()
                out = [(b, a, z) for b, (a, z) in enumerate(zip(at, at[1:])) if z > a]
                if not out:
                    continue
                columns = [
                    pa.array([b for b, _, _ in out], pa.int32()), pa.array([row["chunk"]] * len(out), pa.int64()),
                    pa.array([squeezed(keys[a:z]) for _, a, z in out], pa.binary()),
                    pa.array([squeezed(low[a:z]) if last else None for _, a, z in out], pa.binary()),
                    pa.array([row["nulls"]] * len(out), pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "keys", "low", "nulls"])

    return in_batches(rows.select("chunk", "nulls", "payload", *names), run, "bucket int, chunk long, keys binary, low binary, nulls boolean")


def _answers(requests: DataFrame, last: bool) -> DataFrame:
    """One bit per requested hash: known elsewhere, or at the last level to a smaller document elsewhere."""

    def run(table: pa.Table) -> pa.Table:
        keys = [restored(k) for k in table["keys"].to_pylist()]
        every = np.concatenate(keys)
        distinct, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
        if last:
            low = np.concatenate([restored(v).view(np.int64) for v in table["low"].to_pylist()])
            least = np.full(len(distinct), NULL_ID)
            np.minimum.at(least, inverse, low)
            # A null identifier is larger than any number, the largest included.
            nulls = np.repeat(table["nulls"].to_numpy(), [len(k) for k in keys])
            numbered = np.zeros(len(distinct), bool)
            numbered[inverse[~nulls]] = True
            bits = (least[inverse] < low) | (nulls & numbered[inverse])
        else:
            bits = counts[inverse] > 1
        ends = np.cumsum([len(k) for k in keys])
        packed_bits = [np.packbits(b).tobytes() for b in np.split(bits, ends[:-1])]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "n": pa.array([len(k) for k in keys], pa.int32()), "bits": pa.array(packed_bits, pa.binary())})

    found = requests.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, n int, bits binary")
    return found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "n", "bits"))).alias("bits"))


def _bits(answer: list | None) -> np.ndarray:
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool) for a in answer or ()]
    return np.concatenate(parts) if parts else np.empty(0, bool)


def _replayed(row: dict, lengths: list[int], level: int, buckets: int) -> Chunk:
    chunk = Chunk(row["payload"], lengths[-1], buckets)
    for i in range(level):
        chunk.narrowed(lengths[i], _bits(row[f"bits{i}"]))
    return chunk


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = 13) -> DataFrame:
    """One row per document: id, n_words, n_removed, spans (start, end in words), kept (the words left).

    A word is removed when a window over it also starts in a document with a smaller identifier.
    """
    lengths = levels(min_words)
    packs = stored(chunks(docs, id_column, text, min_words), "chunks")
    total = packs.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-total // BUCKET_WINDOWS))
    rows, names = packs, []
    for level in range(len(lengths)):
        requests = _requests(rows, names, level, lengths, buckets)
        answers = stored(_answers(requests, level == len(lengths) - 1), "answers").withColumnRenamed("bits", f"bits{level}")
        rows = rows.join(answers, "chunk", "left")
        names.append(f"bits{level}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _replayed(row, lengths, len(lengths) - 1, buckets)
                marks = chunk.removed(_bits(row[names[-1]]))
                yield _result(chunk, marks, id_column, row["nulls"])

    fields = f"`{id_column}` long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"
    return in_batches(rows.select("chunk", "nulls", "payload", *names), run, fields)


def _result(chunk: Chunk, marks: np.ndarray, id_column: str, nulls: bool) -> pa.RecordBatch:
    spans, kept, removed = [], [], []
    for i, words in enumerate(chunk.texts):
        own = marks[chunk.offsets[i] : chunk.offsets[i + 1]]
        edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
        ranges = list(zip(edges[::2], edges[1::2]))
        spans.append([{"start": a, "end": b} for a, b in ranges])
        removed.append(sum(b - a for a, b in ranges))
        left, at = [], 0
        for a, b in ranges:
            left += words[at:a]
            at = b
        kept.append(b" ".join(left + words[at:]).decode("utf-8"))
    ids = pa.nulls(len(chunk.ids), pa.int64()) if nulls else pa.array(chunk.ids, pa.int64())
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(chunk.offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
        [id_column, "n_words", "n_removed", "spans", "kept"],
    )
