"""Connected components of similar texts, from candidate edges to verified links.

Banding gives edges from each text to the smallest text of its bucket. Their components are only
candidates; a true component never leaves one. A candidate component of bounded size meets in one
place, where every pair not yet connected is compared on full sets, unless the signatures rule it
out by five standard deviations. A larger one is first dealt into blocks that each also get the
component's first text, the hub: whatever is similar to the hub is connected across blocks at once,
and every text learns its distance to the hub. What is then still apart meets in tiles. The Jaccard
distance is a metric, so linked texts differ in their distances to the hub by no more than the
threshold distance: cells of that width need to meet only themselves and the next cell. Tiles return links,
never pairs, and compare only texts of different components. No link is lost to a cap.

An item is (id, text), one row per distinct text. Identifiers are longs without nulls.
"""

from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.storage import stored
from wakeline.llm.words import GOLDEN, in_batches, mixed, utf8
from wakeline.models.components import components
from wakeline.session import small_side

BLOCK = 256
TILE = 512
BYTES = 16 << 20
SLICE_BYTES = 1 << 20


class Measure(ABC):
    """Sets, signatures and threshold of a similarity; picklable, all numpy."""

    bands: int
    rows: int
    #: Similar when 100 x intersection >= percent x union.
    percent: int

    @abstractmethod
    def sets(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(element, text number) of all texts; elements may repeat, texts are in order."""

    @abstractmethod
    def signatures(self, elements: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """n x (bands x rows) numbers; texts without elements have some constant."""

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """n x bands bucket keys."""
        n = len(signatures)
        parts = signatures.reshape(n, self.bands, self.rows).astype(np.uint64)
        total = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * GOLDEN, (n, self.bands)).copy()
        for i in range(self.rows):
            total = mixed(total ^ parts[:, :, i]) + GOLDEN
        return total

    def similarity(self, a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        """(size of the intersection, of the union) of sorted distinct elements."""
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both, len(a) + len(b) - both

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        if 100 * min(len(a), len(b)) < self.percent * max(len(a), len(b)) or not len(a):
            return False
        both, either = self.similarity(a, b)
        return 100 * both >= self.percent * either

    def plausible(self) -> float:
        """Least share of equal signature entries; a linked pair is below it by chance 1 in 3 million."""
        p, m = self.percent / 100, self.bands * self.rows
        return p - 5 * (p * (1 - p) / m) ** 0.5

    def distinct_sets(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """(sorted distinct elements of each text, signatures), a slice of the texts at a time."""
        sets, signatures, begin, size = [], [], 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= SLICE_BYTES or i == len(texts) - 1:
                own, table = self._slice(texts[begin : i + 1])
                sets += own
                signatures.append(table)
                begin, size = i + 1, 0
        return sets, np.concatenate(signatures) if signatures else np.empty((0, self.bands * self.rows), np.uint32)

    def _slice(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        elements, owner = self.sets(texts)
        signatures = self.signatures(elements, owner, len(texts))
        order = np.lexsort((elements, owner))
        elements, owner = elements[order], owner[order]
        first = np.ones(len(elements), bool)
        first[1:] = (elements[1:] != elements[:-1]) | (owner[1:] != owner[:-1])
        elements, owner = elements[first], owner[first]
        return np.split(elements, np.searchsorted(owner, np.arange(1, len(texts)))), signatures


class Sets:
    """Union-find over positions, the smaller position is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.up[b] = a


def connected(measure: Measure, sets: list[np.ndarray], signatures: np.ndarray, labels: list[int], parts: list[int] | None = None) -> Sets:
    """Union-find over positions: equal labels are connected, and so are linked texts.

    With two ``parts``, only texts of different parts are compared; the rest meets elsewhere.
    """
    found, first, least = Sets(len(sets)), {}, measure.plausible()
    for i, label in enumerate(labels):
        found.join(first.setdefault(label, i), i)
    across = np.array(parts) if parts is not None and len(set(parts)) > 1 else None
    for i in range(1, len(sets)):
        near = (signatures[:i] == signatures[i]).mean(axis=1) >= least
        if across is not None:
            near &= across[:i] != across[i]
        for j in np.flatnonzero(near).tolist():
            if found.root(i) != found.root(j) and measure.linked(sets[i], sets[j]):
                found.join(i, j)
    return found


def edges(rows: DataFrame) -> DataFrame:
    """(u, v): each id of a (band, id) table with the smallest id of its bucket.

    The smallest is a partial aggregate; a bucket's rows meet it in a join that can be split.
    """
    hubs = rows.groupBy("band").agg(F.min("id").alias("v"), F.max("id").alias("last")).where("v <> last").drop("last")
    return rows.join(hubs, "band").where("id <> v").select(F.col("id").alias("u"), "v").distinct()


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows with equal leading columns, over batch borders."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(utf8(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns)):
            if rows and rows[0][:keys] != row[:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def similar_components(items: DataFrame, candidate_edges: DataFrame, measure: Measure) -> DataFrame:
    """(id, root) of every item that is linked with another; root is the smallest id reachable."""
    spark = items.sparkSession
    candidates = stored(candidate_edges, "edges")
    if candidates.isEmpty():
        return spark.createDataFrame([], "id long, root long")
    groups = small_side(components(candidates).select(F.col("node").alias("id"), F.col("root").alias("hub")))
    lengths = items.select("id", F.octet_length("text").alias("bytes")).join(groups, "id")
    members = stored(lengths.select("id", "hub", "bytes"), "members")
    sizes = members.groupBy("hub").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BYTES)).cast("int")
    large = stored(sizes.select("hub", blocks.alias("blocks"), "n").where("blocks > 1 and n > 2").drop("n"), "large")
    placed = members.select("id", "hub").join(large, "hub", "left").select(
        "id", "hub", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("blocks")) + 1).cast("int").alias("block"),
    )
    hubs = large.select("hub", F.explode(F.sequence(F.lit(1), "blocks")).alias("block")).select(F.col("hub").alias("id"), "hub", "block")
    placed = small_side(placed.unionByName(hubs).distinct())
    texts = _gathered(items.join(placed, "id").select("hub", "block", "id", "text"), ["hub", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 2):
            ids = [r[2] for r in rows]
            sets, signatures = measure.distinct_sets([r[3] for r in rows])
            found = connected(measure, sets, signatures, ids)
            far = [0.0] * len(ids)
            if rows[0][1]:
                hub = sets[ids.index(rows[0][0])]
                far = [1 - both / max(1, either) for both, either in (measure.similarity(hub, s) for s in sets)]
            columns = [
                pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] > 0 for r in rows], pa.bool_()), pa.array(ids, pa.int64()),
                pa.array([ids[found.root(i)] for i in range(len(ids))], pa.int64()), pa.array(far, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["hub", "large", "id", "root", "far"])

    found = stored(in_batches(texts, run, "hub long, large boolean, id long, root long, far double"), "found")
    small = found.where("not large and id <> root").select("id", "root")
    small = small.unionByName(small.select(F.col("root").alias("id"), "root").distinct())
    if large.isEmpty():
        return small
    return small.unionByName(_settled(items, found.where("large"), measure))


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys one after another in one partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, "id")


def _settled(items: DataFrame, found: DataFrame, measure: Measure) -> DataFrame:
    """(id, root) of all texts of large candidate components, after tiles of what is still apart."""
    links = found.select(F.col("id").alias("u"), F.col("root").alias("v"))
    roots = components(links).select(F.col("node").alias("id"), "root")
    members = found.select("hub", "id", "far").distinct().join(roots, "id", "left").select("hub", "id", "far", F.coalesce("root", "id").alias("root"))
    members = stored(members, "members")
    apart = members.groupBy("hub").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("hub")
    width = (1 - measure.percent / 100) * 1.0001
    cells = members.join(apart, "hub").withColumn("cell", F.floor(F.col("far") / width).cast("int"))
    lengths = items.select("id", F.octet_length("text").alias("bytes"))
    cells = stored(lengths.join(small_side(cells), "id"), "cells")
    sizes = cells.groupBy("hub", "cell").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("bytes") / BYTES)).cast("int").alias("slices"))
    sizes = stored(sizes, "slices")
    beside = lambda step, name: sizes.select("hub", (F.col("cell") - step).alias("cell"), F.col("slices").alias(name))
    cells = cells.join(sizes, ["hub", "cell"]).join(beside(1, "after"), ["hub", "cell"], "left").join(beside(-1, "before"), ["hub", "cell"], "left")
    own = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
    cells = cells.withColumn("own", own)
    places = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    tile = lambda c, i, d, j: F.struct(c.alias("c"), i.alias("i"), d.alias("d"), j.alias("j"))
    c, s = F.col("cell"), F.col("own")
    tiles = F.concat(
        F.transform(places(F.col("slices")), lambda t: tile(c, F.least(s, t), c, F.greatest(s, t))),
        F.transform(places(F.col("after")), lambda t: tile(c, s, c + 1, t)),
        F.transform(places(F.col("before")), lambda t: tile(c - 1, t, c, s)),
    )
    placed = cells.select("hub", "id", "root", F.concat_ws("/", "cell", "own").alias("part"), F.explode(tiles).alias("tile"))
    placed = small_side(placed.select("hub", F.concat_ws("/", "tile.*").alias("tile"), "id", "root", "part"))
    texts = _gathered(items.join(placed, "id").select("hub", "tile", "id", "root", "part", "text"), ["hub", "tile"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 2):
            labels = [r[3] for r in rows]
            if len(set(labels)) == 1:
                continue
            sets, signatures = measure.distinct_sets([r[5] for r in rows])
            joined = connected(measure, sets, signatures, labels, [r[4] for r in rows])
            # Of two labels that are connected here the link goes from label to label.
            links = {(x, labels[joined.root(i)]) for i, x in enumerate(labels)}
            links = [(u, v) for u, v in links if u != v]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    more = stored(in_batches(texts, run, "u long, v long"), "links")
    every = links.unionByName(more)
    final = components(every).select(F.col("node").alias("id"), "root")
    return members.select("id").join(final, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
