"""Exact nearest neighbours and neighbour counts through bounded blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.models.cells import CELL_ROWS, build, measured, other_cells, with_cell
from wakeline.operators.pairwise import STEP, reduce_pairs, squared_distances, stacked
from wakeline.session import checkpointed


def nearest(train: DataFrame, rows: DataFrame, features: list[str], k: int = 5, label: str = "Type", cell_rows: int = CELL_ROWS) -> DataFrame:
    """The k nearest training rows of every row: (id, actual, neighbour, label, distance2).

    Training rows lie in the cells of a k-d index. A row is compared with its own cell first. Its k-th
    distance there certifies the result unless another cell's box is nearer, and only then is the row sent
    to that cell. Of equal training points only the k smallest ids can be neighbours, so a point that is
    met very often is k rows. Ties go to the smaller training id.
    """
    alike = Window.partitionBy(*features).orderBy("id")
    base = train.select("id", label, *features).withColumn("_copy", F.row_number().over(alike)).where(F.col("_copy") <= k).drop("_copy")
    base = checkpointed(base)
    index = build(base, features, cell_rows)
    base = checkpointed(with_cell(base, index, features))
    index = measured(index, base, features)
    home = checkpointed(with_cell(rows.select("id", F.col(label).alias("actual"), *features), index, features))
    first = checkpointed(_first(_closest_in_cells(base, home, features, k, label), k))
    limits = first.groupBy("id").agg(F.when(F.count("*") == k, F.max("distance2")).alias("limit"))
    wider = other_cells(home.join(limits, "id", "left"), index, features, "limit").drop("limit")
    return _first(first.drop("rank").unionByName(_closest_in_cells(base, wider, features, k, label)), k)


def pairs_compared(base: DataFrame, home: DataFrame, wider: DataFrame) -> int:
    """Distances that a search takes, from rows that carry their cell."""
    sizes = base.groupBy("cell").agg(F.count("*").alias("there"))
    here = home.select("cell").unionByName(wider.select("cell")).groupBy("cell").agg(F.count("*").alias("here"))
    return here.join(sizes, "cell").agg(F.coalesce(F.sum(F.col("here") * F.col("there")), F.lit(0))).first()[0]


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy("distance2", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _closest_in_cells(base: DataFrame, home: DataFrame, features: list[str], k: int, label: str) -> DataFrame:
    """Of every block of a cell the k nearest rows; a cell with many rows is many blocks."""

    def closest(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        parts = []
        there = there.sort_values("id")
        a, b = here[features].to_numpy(), there[features].to_numpy()
        keep = min(k, len(there))
        for at in range(0, len(here) if keep else 0, STEP):
            block = here.iloc[at:at + STEP]
            distance = squared_distances(a[at:at + STEP], b)
            # The k-th smallest distance is a bound; among those at the bound the smaller id wins.
            limit = np.partition(distance, keep - 1, axis=1)[:, keep - 1:keep]
            row, column = np.nonzero(distance <= limit)
            found = pd.DataFrame({
                "id": block["id"].to_numpy()[row], "actual": block["actual"].to_numpy()[row],
                "neighbour": there["id"].to_numpy()[column], "label": there[label].to_numpy()[column],
                "distance2": distance[row, column],
            }).sort_values(["id", "distance2", "neighbour"])
            parts.append(found.groupby("id").head(keep))
        return stacked(parts, ["id", "actual", "neighbour", "label", "distance2"])

    return reduce_pairs(
        home, base, "cell", closest, "id long, actual int, neighbour long, label int, distance2 double"
    )


def knn_predictions(train: DataFrame, rows: DataFrame, features: list[str], k: int = 5) -> DataFrame:
    """Majority label of the k nearest, the smallest label on ties: (id, actual, predicted)."""
    votes = nearest(train, rows, features, k).groupBy("id", "actual", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("id", "actual").agg(
        F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("predicted")
    )


AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
FORWARD = [o for o in AROUND if o >= (0, 0)]


def with_tiles(points: DataFrame, features: list[str], side: float, offsets: list[tuple[int, int]] = AROUND) -> tuple[DataFrame, DataFrame]:
    """Points in their own tile, and copies of them in the tiles around it, marked ``other`` outside their own.

    Tiles are squares of the first two features; a point within `side` of another is always in
    one of the nine tiles.
    """
    x, y = (F.floor(F.col(f) / F.lit(side)) for f in features[:2])
    name = F.concat_ws(":", x, y)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    home = points.withColumn("tile", name)
    halo = points.withColumn("_o", F.explode(steps)).withColumn(
        "tile", F.concat_ws(":", x + F.col("_o.i"), y + F.col("_o.j"))
    ).withColumn("other", (F.col("_o.i") != 0) | (F.col("_o.j") != 0)).drop("_o")
    return home, halo


def neighbour_counts(points: DataFrame, features: list[str], eps: float) -> DataFrame:
    """Rows within eps of every row, itself included: (id, neighbours).

    A distance between two tiles counts for both its rows, so a point is copied to its own tile and the
    four that follow it, not to all nine.
    """
    home, halo = with_tiles(points.select("id", *features), features, eps, FORWARD)

    def count(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        a, b = here[features].to_numpy(), there[features].to_numpy()
        other = there["other"].to_numpy()
        own, back = np.zeros(len(here), dtype="int64"), np.zeros(len(there), dtype="int64")
        for at in range(0, len(here), STEP):
            near = squared_distances(a[at:at + STEP], b) <= eps * eps
            own[at:at + STEP] = near.sum(axis=1)
            back += near.sum(axis=0)
        return pd.DataFrame({"id": np.concatenate((here["id"], there["id"][other])), "n": np.concatenate((own, back[other]))})

    counted = reduce_pairs(home, halo, "tile", count, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("neighbours"))
