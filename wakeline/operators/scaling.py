"""Feature scaling fitted on one frame and applied to another."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_standard(train: DataFrame, columns: list[str]) -> DataFrame:
    """One row of means and population deviations; a constant column scales by one."""
    return train.agg(*[
        f for c in columns for f in (
            F.avg(c).alias(f"{c}__shift"),
            F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}__scale"),
        )
    ])


def fit_minmax(train: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:
    """Minimum and width per column, one row overall or one row per key."""
    return train.groupBy(*keys).agg(*[
        f for c in columns for f in (
            F.min(c).cast("double").alias(f"{c}__shift"),
            F.coalesce(F.nullif((F.max(c) - F.min(c)).cast("double"), F.lit(0.0)), F.lit(1.0)).alias(f"{c}__scale"),
        )
    ])


def apply_scaling(df: DataFrame, fitted: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:
    """Replace the columns by their scaled values.

    Without keys `fitted` is a single row. It is carried as one joined constant, so the fitted
    values stay in the plan and the rows are not shuffled.
    """
    if keys:
        joined = df.join(fitted, keys, "left")
    else:
        one = F.broadcast(fitted.withColumn("_one", F.lit(1)))
        joined = df.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")
    scaled = joined.withColumns({c: (F.col(c) - F.col(f"{c}__shift")) / F.col(f"{c}__scale") for c in columns})
    return scaled.select(*df.columns)


def standardised(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    return apply_scaling(rows, fit_standard(train, columns), columns)


def minmax_scaled(train: DataFrame, rows: DataFrame, columns: list[str], keys: list[str] = []) -> DataFrame:
    return apply_scaling(rows, fit_minmax(train, columns, keys), columns, keys)
