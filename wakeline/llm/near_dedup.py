"""Near duplicates by SuperMinHash, banding, verification on full sets and union-find.

Signature: every element of a set walks through its own random permutation of the signature's
places; step j offers the place it visits the value j plus a fraction. An element's values are thus
correlated over the places, which lowers the variance of the estimate, and the walk stops as soon as j
exceeds the largest whole part in the signature, after one or two steps for long texts. All elements
of a block of texts take step j together.

Copies with equal word sequences are one item, represented by their smallest identifier, so a hot group of
copies takes part once. Candidate buckets, verification and components are those of similar.py.

Defined results: null, empty and blank texts have an empty set, are linked with nothing and kept; a text of
fewer than five words is one shingle; rows with the same identifier and text are alike; a row
without identifier is kept, has no component and links nothing; an empty table gives no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.similar import Measure, edges, similar_components
from wakeline.llm.storage import stored
from wakeline.llm.words import blocks, hashed, in_batches, mixed, shingles, signed, step, utf8
from wakeline.session import small_side

FRACTION_BITS = 24


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """n x size signatures of the sets of elements (repetitions do not matter)."""
    empty = np.uint32(size << FRACTION_BITS)
    table = np.full(n * size, empty, np.uint32)
    live, base, places = elements, owner * size, None
    for j in range(size):
        random = mixed(live + step(j + 1))
        value = np.uint32(j << FRACTION_BITS) | (random >> np.uint64(64 - FRACTION_BITS)).astype(np.uint32)
        pick = j + (((random & np.uint64(0xFFFFFFFF)) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
        if places is None:
            np.minimum.at(table, base + pick, value)
            first = pick
        else:
            row = np.arange(len(live))
            chosen = places[row, pick]
            places[row, pick] = places[:, j]
            places[:, j] = chosen
            np.minimum.at(table, base + chosen, value)
        most = (table.reshape(n, size).max(axis=1) >> np.uint32(FRACTION_BITS)).astype(np.int64) if n else np.empty(0, np.int64)
        goes = most[base // size] > j
        if not goes.any():
            break
        live, base = live[goes], base[goes]
        if places is None:
            places = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(live), 1))
            first = first[goes]
            row = np.arange(len(live))
            places[row, first] = 0
            places[:, 0] = first
        else:
            places = places[goes]
    return table.reshape(n, size)


class WordShingles(Measure):
    """Distinct runs of ``length`` words, A-Z lower-cased."""

    def __init__(self, percent: int, length: int = 5, bands: int = 25, rows: int = 4):
        self.percent, self.length, self.bands, self.rows = percent, length, bands, rows

    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        values, owner = shingles(*hashed([t.lower().split() for t in texts]), self.length)
        order = np.argsort(owner, kind="stable")
        return values[order], owner[order]

    def signatures(self, elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return super_minhash(elements, owner, n, self.bands * self.rows)


def sketches(docs: DataFrame, measure: Measure, id_column: str, text: str) -> DataFrame:
    """(id, same, n_shingles, bands): ``same`` names the word sequence, null where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 1, 2 << 20):
            texts = utf8(batch.column(1))
            n = len(texts)
            sets, signatures = measure.distinct_sets(texts)
            sizes = np.array([len(s) for s in sets], np.int64)
            same = [xxhash.xxh3_128_digest(b" ".join(t.lower().split())) if s else None for t, s in zip(texts, sizes)]
            keys = signed(np.ascontiguousarray(measure.keys(signatures)))
            offsets = pa.array(np.arange(0, n * measure.bands + 1, measure.bands), pa.int32())
            columns = [
                batch.column(0), pa.array(same, pa.binary()), pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "same", "n_shingles", "bands"])

    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    return in_batches(rows, run, "id long, same binary, n_shingles long, bands array<long>")


def near_duplicates(docs: DataFrame, percent: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two texts are linked when 100 x intersection >= percent x union of their shingle sets.
    """
    measure = WordShingles(percent)
    rows = stored(sketches(docs, measure, id_column, text), "sketches")
    known = rows.where("id is not null and same is not null")
    copies = stored(known.groupBy("same").agg(F.min("id").alias("rep")), "copies")
    firsts = known.join(copies.select(F.col("rep").alias("id"), "same"), ["id", "same"]).select("id", "bands")
    buckets = firsts.select("id", F.explode("bands").alias("band"))
    # A text's words stand for it; of rows that share an identifier with other words, each is an item.
    items = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    repeated = known.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        return _with_row_ids(docs, percent, id_column, text)
    found = similar_components(items, edges(buckets), measure)
    roots = copies.join(found.select(F.col("id").alias("rep"), "root"), "rep", "left")
    roots = roots.select("same", F.coalesce("root", "rep").alias("component"))
    return _with_components(rows, roots, id_column)


def _with_components(rows: DataFrame, roots: DataFrame, id_column: str) -> DataFrame:
    """Every row with the component of its word sequence; rows without words or id are their own."""
    joined = rows.select("id", "same", "n_shingles").join(roots, "same", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return joined.select(
        F.col("id").alias(id_column), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _with_row_ids(docs: DataFrame, percent: int, id_column: str, text: str) -> DataFrame:
    """The same for tables whose identifiers repeat: rows are numbered in the order of identifiers.

    Of rows with one identifier, the first that is in a component is the kept one.
    """
    numbered = stored(docs.select(F.col(id_column).cast("long").alias("own"), F.col(text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = stored(near_duplicates(numbered, percent, "row", "text"), "numbered_components")
    owners = numbered.select("row", "own")
    linked = found.join(owners, "row")
    best = linked.where("own is not null").groupBy("component_id").agg(F.min(F.struct("own", "row")).alias("best"))
    out = linked.join(best, "component_id", "left")
    has = F.col("own").isNotNull()
    return out.select(
        F.col("own").alias(id_column), "n_shingles", F.when(has, F.col("best.own")).alias("component_id"),
        F.when(has, F.col("row") == F.col("best.row")).otherwise(F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame, percent: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The input rows that stay: one per component, and all without words or identifier.

    Rows that share an identifier stay or go together.
    """
    found = near_duplicates(docs, percent, id_column, text)
    gone = found.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_gone")).agg(F.bool_or("kept").alias("stays"))
    gone = small_side(gone.where("not stays").select("_gone"))
    return docs.join(gone, F.col(id_column).cast("long") == F.col("_gone"), "left_anti")
