"""Which zones a report lies in: containment against a table of polygons, with holes.

Every zone is covered by square cells whose side is a power of two of a degree, chosen by the zone's
extent so that a zone has a bounded number of cells. A cell without any edge lies inside as a whole and
needs no further test; a cell that edges pass keeps the edges that matter for its points. Reports meet
the cells by an equi-join on the cell number, and only those in edge cells are tested.

A point is in a zone by the even-odd rule over all rings, strictly: rings themselves, null and NaN
coordinates are outside. A report in several zones has a row for each; a zone of fewer than three points is empty.
"""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.session import checkpointed

#: Cells along the longer side of a zone: at least half as many, at most one more.
CELLS_PER_SIDE = 64
#: A cell with more than this share of a partition's reports is met by a broadcast.
SHARE = 8
CELL = ["level", "ix", "iy"]
EDGE = "struct<x1:double,y1:double,x2:double,y2:double>"
COVER = f"zone string, level int, ix long, iy long, inner boolean, edges array<{EDGE}>"


def edges_of(rings) -> np.ndarray:
    """Rows x1, y1, x2, y2 of closed rings; open ones are closed."""
    found = []
    for ring in rings if rings is not None else []:
        points = np.array([list(p) for p in ring], np.float64).reshape(-1, 2)
        if len(points) and (points[0] != points[-1]).any():
            points = np.vstack([points, points[:1]])
        found.append(np.hstack([points[:-1], points[1:]]))
    return np.vstack(found) if found else np.zeros((0, 4))


def cells_of(name: str, rings, per_side: int) -> Iterator[tuple]:
    """The cells of one zone that hold inner points, row of cells by row of cells."""
    edges = edges_of(rings)
    if len(edges) < 3:
        return
    x, y = edges[:, [0, 2]], edges[:, [1, 3]]
    extent = max(x.max() - x.min(), y.max() - y.min())
    if not extent > 0 or not math.isfinite(extent):
        return
    level = math.ceil(math.log2(extent / per_side))
    side = 2.0**level  # dividing by a power of two is exact, so a point's cell is too
    columns = np.arange(math.floor(x.min() / side), math.floor(x.max() / side) + 1)
    left, right = columns * side, (columns + 1) * side
    for iy in range(math.floor(y.min() / side), math.floor(y.max() / side) + 1):
        low, high = iy * side, (iy + 1) * side
        band = (y.min(1) <= high) & (y.max(1) >= low)
        own = edges[band]
        ends = own[:, [0, 2]]
        # An edge passes a cell unless their extents are apart or all corners lie on one side of it.
        near = (ends.min(1)[:, None] <= right) & (ends.max(1)[:, None] >= left)
        dx, dy = (own[:, 2] - own[:, 0])[:, None], (own[:, 3] - own[:, 1])[:, None]
        turns = [dx * (cy - own[:, 1:2]) - dy * (cx - own[:, :1]) for cy in (low, high) for cx in (left, right)]
        size = 1e-9 * (np.abs(dx) + np.abs(dy)) * side
        passed = near & ~(np.minimum.reduce(turns) > size) & ~(np.maximum.reduce(turns) < -size)
        middle = low + side / 2
        spans = (own[:, 1] > middle) != (own[:, 3] > middle)
        cross = own[spans, 0] + (own[spans, 2] - own[spans, 0]) * (middle - own[spans, 1]) / (own[spans, 3] - own[spans, 1])
        inside = (cross[:, None] > left + side / 2).sum(0) % 2 == 1
        for i, ix in enumerate(columns):
            if passed[:, i].any():
                # A ray to the right meets only edges that end to the right of the cell's left side.
                kept = own[ends.max(1) >= left[i] - side]
                yield name, level, int(ix), iy, False, [dict(zip(("x1", "y1", "x2", "y2"), e)) for e in kept.tolist()]
            elif inside[i]:
                yield name, level, int(ix), iy, True, None


def cover(zones: DataFrame, name: str = "name", rings: str = "rings", per_side: int = CELLS_PER_SIDE) -> DataFrame:
    """The cells of all zones: zone, level, ix, iy, inner, edges."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for zone, shape in zip(part["name"], part["rings"]):
                found = list(cells_of(zone, shape, per_side))
                yield pd.DataFrame(found, columns=["zone", *CELL, "inner", "edges"])

    return zones.select(F.col(name).alias("name"), F.col(rings).alias("rings")).mapInPandas(run, COVER)


def contains(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over an array of edges; points on an edge are outside."""
    def crossed(e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        return spans & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])

    def touched(e: Column) -> Column:
        turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
        return (turn == 0.0) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))

    return (F.size(F.filter(edges, crossed)) % 2 == 1) & ~F.exists(edges, touched)


def in_zones(
    reports: DataFrame, zones: DataFrame, lon: str = "Longitude", lat: str = "Latitude", name: str = "name", rings: str = "rings",
    per_side: int = CELLS_PER_SIDE,
) -> DataFrame:
    """The reports with the column ``zone``, one row per report and zone that holds it.

    Reports are counted by cell first. Cells that hold a large share of them, a port's anchorage, are few by
    that definition: they go to the reports as a broadcast, the others meet by a shuffle join.
    """
    cells = checkpointed(cover(zones, name, rings, per_side))
    levels = [r.level for r in cells.select("level").distinct().collect()]  # a few: powers of two between a quay and the globe
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    placed = reports.where(x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)).drop("zone")
    at = F.array(*(
        F.struct(F.lit(v).alias("level"), F.floor(x / F.lit(2.0**v)).cast("long").alias("ix"), F.floor(y / F.lit(2.0**v)).cast("long").alias("iy"))
        for v in levels
    )) if levels else F.array().cast("array<struct<level:int,ix:long,iy:long>>")
    keyed = placed.withColumn("_cell", F.explode(at))
    key = [F.col(f"_cell.{c}") == F.col(f"_{c}") for c in CELL]
    met = cells.select("zone", "inner", "edges", *(F.col(c).alias(f"_{c}") for c in CELL))
    share = placed.count() / (SHARE * int(reports.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = keyed.select("_cell.*").join(cells.select(*CELL).distinct(), CELL, "left_semi").groupBy(*CELL).agg(F.count("*").alias("n"))
    full = F.broadcast(held.where(F.col("n") > share).select(*CELL, F.lit(True).alias("_full")))
    marked = checkpointed(met.join(full, [F.col(f"_{c}") == F.col(c) for c in CELL], "left").drop(*CELL))
    hot, cold = marked.where("_full"), marked.where("_full is null")
    crowded = keyed.join(F.broadcast(hot), key)
    others = keyed.join(F.broadcast(hot.select("_level", "_ix", "_iy").distinct()), key, "left_anti").join(cold, key)
    found = crowded.unionByName(others).where(F.col("inner") | contains(F.col("edges"), x, y))
    return found.select(*(F.col(f"`{c}`") for c in placed.columns), "zone")
