"""Density clustering (DBSCAN) on Spark.

Points are put in cells whose diagonal is eps, so that all core points of one cell belong together.
The graph that has to be connected then has cells as nodes, not points, and a crowded cell is a
single node. Distances are only taken inside bounded blocks (see operators.pairwise).
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.models.components import components
from wakeline.models.neighbours import neighbour_counts, with_tiles
from wakeline.operators.pairwise import STEP, reduce_pairs, squared_distances, stacked
from wakeline.session import checkpointed

NOISE = -1


def core_points(points: DataFrame, features: list[str], eps: float, min_samples: int) -> DataFrame:
    """(id, neighbours, core)."""
    counts = neighbour_counts(points, features, eps)
    return counts.withColumn("core", F.col("neighbours") >= min_samples)


def dbscan(points: DataFrame, features: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Adds cluster: 0.. in the order of each cluster's smallest core id, -1 for noise.

    A border point within reach of several clusters takes the first of them.
    """
    side = eps / math.sqrt(len(features))
    cell = F.concat_ws(":", *[F.floor(F.col(f) / F.lit(side)) for f in features])
    marked = checkpointed(
        points.join(core_points(points, features, eps, min_samples), "id").withColumn("cell", cell)
    )
    core = marked.where("core")
    nodes = core.groupBy("cell").agg(F.min("id").alias("node"))
    core = core.join(nodes, "cell").select("id", "node", *features)

    linked = components(_cell_links(core, features, eps))
    roots = nodes.select("node").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    labelled_core = checkpointed(core.join(roots, "node"))
    border = _nearest_roots(marked.where("not core"), labelled_core, features, eps)

    numbers = _numbered(labelled_core.select("root").distinct())
    members = labelled_core.select("id", "root").unionByName(border).join(numbers, "root").select("id", "cluster")
    return points.join(members, "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(NOISE)))


def _numbered(roots: DataFrame) -> DataFrame:
    """(root, cluster): 0.. by root, counted within ranges of roots and continued from range to range."""
    ranged = checkpointed(roots.repartitionByRange("root").withColumn("range", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("range")) - F.col("n")  # one row a range
    starts = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("range").orderBy("root")) - 1
    return ranged.join(F.broadcast(starts), "range").select("root", (F.col("start") + place).cast("int").alias("cluster"))


def _cell_links(core: DataFrame, features: list[str], eps: float) -> DataFrame:
    """Distinct pairs of cells that have core points within eps of each other."""
    home, halo = with_tiles(core, features, eps)

    def links(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        a, b = here[features].to_numpy(), there[features].to_numpy()
        u, v = here["node"].to_numpy(), there["node"].to_numpy()
        parts = []
        for at in range(0, len(here), STEP):
            row, column = np.nonzero(squared_distances(a[at:at + STEP], b) <= eps * eps)
            pair = pd.DataFrame({"u": u[at:at + STEP][row], "v": v[column]})
            parts.append(pair[pair["u"] < pair["v"]].drop_duplicates())
        return stacked(parts, ["u", "v"]).drop_duplicates()

    return reduce_pairs(home, halo, "tile", links, "u long, v long").distinct()


def _nearest_roots(others: DataFrame, core: DataFrame, features: list[str], eps: float) -> DataFrame:
    """The smallest cluster root within eps of each point that is not core; none for noise."""
    home, _ = with_tiles(others.select("id", *features), features, eps)
    _, halo = with_tiles(core.select("id", "root", *features), features, eps)

    def reach(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        a, b = here[features].to_numpy(), there[features].to_numpy()
        roots, none = there["root"].to_numpy(dtype="int64"), np.iinfo("int64").max
        best = np.full(len(here), none)
        for at in range(0, len(here) if len(there) else 0, STEP):
            near = squared_distances(a[at:at + STEP], b) <= eps * eps
            best[at:at + STEP] = np.where(near, roots[None, :], none).min(axis=1)
        found = best != none
        return pd.DataFrame({"id": here["id"].to_numpy()[found], "root": best[found]})

    found = reduce_pairs(home, halo, "tile", reach, "id long, root long")
    return found.groupBy("id").agg(F.min("root").alias("root"))
