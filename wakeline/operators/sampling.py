"""Deterministic samples and splits.

Rows are ordered by a portable pseudo-random key of their id. The smallest n of a group are found
by counting rows per key range and cutting at the range where the count reaches n; only the rows
of that one range are ranked. No group is sorted as a whole.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.constants import CLASS_SAMPLE_ROWS, EXCLUDED_CLASSES, TRAIN_FRACTION
from wakeline.operators.prepare import usable_classes

# The largest prime below 2^31; keys lie in [0, KEY_SPACE).
KEY_SPACE = 2147483647
RANGES = 4096
SALTS = 64


def shuffle_key(row_id: Column | str) -> Column:
    """Pseudo-random position of a row, the same in every engine with 64-bit integers.

    Scrambled twice: one round leaves ids below 44 487 in their own order.
    """
    c = F.col(row_id) if isinstance(row_id, str) else row_id
    for _ in range(2):
        c = F.pmod(F.pmod(c, F.lit(1000003)) * 48271 + 12345, F.lit(KEY_SPACE))
    return c


def take_smallest(df: DataFrame, keys: list[str], wanted: Column, row_id: str = "id") -> DataFrame:
    """The `wanted` first rows of every group by (shuffle key, id), in two passes over the rows.

    `wanted` may use the columns total (rows of the group) and groups (number of groups). Groups
    are classes: their cuts are few rows and are broadcast.
    """
    rows = df.withColumn("_range", F.floor(shuffle_key(row_id) / F.lit(KEY_SPACE / RANGES)).cast("int"))
    filled = rows.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    # One row per group with its at most RANGES counts; the fold stops at the first range that does
    # not fit whole.
    fold = f"""aggregate(_parts, struct(0L as whole, {RANGES} as cut), (a, p) ->
        if(a.cut < {RANGES}, a, if(a.whole + p._n <= _wanted,
            struct(a.whole + p._n as whole, {RANGES} as cut), struct(a.whole as whole, p._range as cut))))"""
    cuts = (
        filled.groupBy(*keys)
        .agg(F.sum("_n").alias("total"), F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("_parts"))
        .withColumn("groups", F.expr("count(*) over ()"))
        .withColumn("_wanted", wanted.cast("bigint"))
        .withColumn("_at", F.expr(fold))
        .select(*keys, F.col("_at.cut").alias("_cut"), (F.col("_wanted") - F.col("_at.whole")).alias("_open"))
    )
    near = rows.join(F.broadcast(cuts), keys).where(F.col("_range") <= F.col("_cut"))
    # Only the range at the cut needs ranks: first in salted parts, then among the survivors.
    near = near.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(SALTS)))
    for part in (["_range", "_salt"], ["_range"]):
        rank = F.row_number().over(Window.partitionBy(*keys, *part).orderBy(shuffle_key(row_id), row_id))
        near = near.withColumn("_rank", rank).where(
            (F.col("_range") < F.col("_cut")) | (F.col("_rank") <= F.col("_open"))
        )
    return near.select(*df.columns)


def fixed_sample(df: DataFrame, rows: int, row_id: str = "id") -> DataFrame:
    """The given number of rows, or all of them when there are fewer."""
    return take_smallest(df.withColumn("_all", F.lit(0)), ["_all"], F.lit(rows), row_id).drop("_all")


def balanced_sample(
    df: DataFrame, total: int = CLASS_SAMPLE_ROWS, excluded: list[int] = EXCLUDED_CLASSES
) -> DataFrame:
    """Even quota of rows per usable class."""
    return take_smallest(usable_classes(df, excluded), ["Type"], F.floor(F.lit(total) / F.col("groups")))


def stratified_split(df: DataFrame, fraction: float = TRAIN_FRACTION, label: str = "Type") -> DataFrame:
    """Adds split = train/test; every class puts floor(fraction x rows) rows in train.

    `df` is read three times: hand over a stored or checkpointed sample.
    """
    train = take_smallest(df.select("id", label), [label], F.floor(F.col("total") * F.lit(fraction)))
    marks = train.select("id", F.lit("train").alias("split"))
    return df.join(marks, "id", "left").withColumn("split", F.coalesce("split", F.lit("test")))


def shuffled(df: DataFrame, row_id: str = "id") -> DataFrame:
    return df.orderBy(shuffle_key(row_id), row_id)
