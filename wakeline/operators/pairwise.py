"""Reductions over pairs of rows without emitting the pairs.

Both sides are cut into bounded blocks by a hash of the row id; every (home block, candidate
block) of a tile meets in one task, which reduces it to a few rows per home row. A tile that
holds most of the data just gets more blocks. Block sizes bound what a task holds in memory.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOME_ROWS = 8192
CANDIDATE_ROWS = 4096
# Home rows handled at once inside a block: the distance matrix then stays in the processor cache.
STEP = 32


def reduce_pairs(
    home: DataFrame,
    candidates: DataFrame,
    tile: str | None,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    row_id: str = "id",
    home_rows: int = HOME_ROWS,
    candidate_rows: int = CANDIDATE_ROWS,
) -> DataFrame:
    """Apply fn(home block, candidate block) to all blocks that share a tile value.

    Without a tile all rows form one; its block counts are then a single row and are broadcast.
    """
    whole = tile is None
    if whole:
        tile = "tile"
        home, candidates = home.withColumn(tile, F.lit(0)), candidates.withColumn(tile, F.lit(0))
    sizes = _blocks(home, tile, home_rows, "homes").join(_blocks(candidates, tile, candidate_rows, "cands"), tile)
    sizes = F.broadcast(sizes) if whole else sizes
    split = {
        "home": _spread(home.join(sizes, tile), row_id, "homes", "cands", "home_block", "cand_block"),
        "cand": _spread(candidates.join(sizes, tile), row_id, "cands", "homes", "cand_block", "home_block"),
    }
    keys = [tile, "home_block", "cand_block"]
    # Both sides may come from one frame: new column identities keep them apart. The blocks are
    # small in bytes and heavy in work, so their number of tasks is set, not left to coalescing.
    tasks = 2 * home.sparkSession.sparkContext.defaultParallelism
    others = split["cand"].toDF(*split["cand"].columns).repartition(tasks, *keys)
    return (
        split["home"].repartition(tasks, *keys).groupBy(*keys)
        .cogroup(others.groupBy(*keys))
        .applyInPandas(lambda h, c: fn(h, c), schema)
    )


def _blocks(df: DataFrame, tile: str, rows: int, name: str) -> DataFrame:
    return df.groupBy(tile).agg(F.ceil(F.count("*") / F.lit(rows)).cast("int").alias(name))


def _spread(df: DataFrame, row_id: str, own: str, other: str, own_block: str, other_block: str) -> DataFrame:
    """Put each row in one block of its own side and copy it to every block of the other side."""
    return df.withColumns({
        own_block: F.pmod(F.xxhash64(row_id), F.col(own)).cast("int"),
        other_block: F.explode(F.sequence(F.lit(0), F.col(other) - 1)),
    }).drop("homes", "cands")


def squared_distances(a, b):
    """Matrix of squared Euclidean distances, summed coordinate by coordinate without cancellation."""
    columns = np.ascontiguousarray(b.T)
    total = a[:, 0, None] - columns[0]
    total *= total
    step = np.empty_like(total)
    for k in range(1, len(columns)):
        np.subtract(a[:, k, None], columns[k], out=step)
        step *= step
        total += step
    return total


def stacked(parts: list[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """Parts below each other with their own types, or an empty frame when there are none."""
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=columns)
