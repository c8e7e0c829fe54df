"""Column summaries and pairwise correlation, overall or per key."""

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.quantiles import sketch, sketched_quantiles, value_counts
from wakeline.session import checkpointed

NUMERIC = ["id", "timestamp", "MMSI", "Latitude", "Longitude", "Distance", "Bearing", "year", "hour"]
CATEGORICAL = ["Type", "date", "MID", "Country"]
QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def _stack(df: DataFrame, keys: list[str], columns: list[str], fields: dict[str, str]) -> DataFrame:
    """Turn one wide row per key, columns `{column}__{field}`, into one row per column."""
    rows = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{f}").cast(t).alias(f) for f, t in fields.items()])
        for c in columns
    ]
    return df.select(*keys, F.inline(F.array(*rows)))


def describe_numeric(df: DataFrame, keys: list[str], columns: list[str] = NUMERIC) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max of every column."""
    measured = [c for c in columns if c not in keys]
    statistics = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sketch": sketch}
    aggregates = [f(F.col(c).cast("double")).alias(f"{c}__{name}") for c in measured for name, f in statistics.items()]
    fields = {"count": "bigint", "mean": "double", "std": "double", "min": "double", "max": "double", "sketch": "binary"}
    summary = checkpointed(_stack(df.groupBy(*keys).agg(*aggregates), keys, measured, fields))
    long = df.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in measured
        ])),
    )
    group = [*keys, "column_name"]
    quartiles = sketched_quantiles(long, summary, group, list(QUARTILES.values()))
    wide = quartiles.groupBy(*group).agg(*[
        F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for name, p in QUARTILES.items()
    ])
    return summary.drop("sketch").join(F.broadcast(wide), group, "left")


def describe_categorical(df: DataFrame, keys: list[str], columns: list[str] = CATEGORICAL) -> DataFrame:
    """count, distinct values, most frequent value (the smallest on ties) and its frequency."""
    long = df.select(
        *keys,
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
        ])),
    )
    group = [*keys, "column_name"]
    # The highest count first, then the smallest value among its holders.
    return value_counts(long, group).groupBy(*group).agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"), F.max("n").alias("freq"),
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("top"),
    )


def describe(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """One row per column; fields that do not apply to its kind are null."""
    numeric, categorical = describe_numeric(df, keys), describe_categorical(df, keys)
    return numeric.unionByName(categorical, allowMissingColumns=True)


def correlation(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Pearson matrix in long form. Each pair uses the rows where both values are present."""
    pairs = list(combinations_with_replacement(columns, 2))
    wide = df.groupBy(*keys).agg(*[_pearson(a, b).alias(f"{a}__{b}") for a, b in pairs])
    cells = [
        F.struct(F.lit(x).alias("column_a"), F.lit(y).alias("column_b"), F.col(f"{a}__{b}").alias("correlation"))
        for a, b in pairs
        for x, y in dict.fromkeys([(a, b), (b, a)])
    ]
    return wide.select(*keys, F.inline(F.array(*cells)))


def _pearson(a: str, b: str) -> Column:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    return F.corr(F.when(y.isNotNull(), x), F.when(x.isNotNull(), y))
