"""Weekly traffic series and window features.

A series has one row per week, so its length is bounded by the calendar however many reports
stand behind it; windows and arrays per series_key are small.
"""

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wakeline.constants import TEST_START
from wakeline.functions import time


def _by_week() -> WindowSpec:
    return Window.partitionBy("series_key").orderBy("week")


def weekly_vessels(df: DataFrame, source: str | None = None, key: Column | None = None) -> DataFrame:
    """Unique vessels per week as (series_key, week, y).

    With `source` the uniques of every source file are summed, so a vessel in two files of one
    week counts twice; without it vessels are counted once. `key` splits into many series.
    """
    rows = df.where(F.col("timestamp").isNotNull()).select(
        (key if key is not None else F.lit("ALL")).cast("string").alias("series_key"),
        time.week_start("timestamp").alias("week"),
        "MMSI",
        *([F.col(source).alias("source")] if source else []),
    )
    if source is None:
        return rows.groupBy("series_key", "week").agg(F.count_distinct("MMSI").alias("y"))
    per_source = rows.groupBy("series_key", "source", "week").agg(F.count_distinct("MMSI").alias("y"))
    return per_source.groupBy("series_key", "week").agg(F.sum("y").alias("y"))


def split_by_date(series: DataFrame, start: str = TEST_START) -> DataFrame:
    """Adds split: test from the given date on."""
    return series.withColumn("split", F.when(F.col("week") >= F.lit(start).cast("date"), "test").otherwise("train"))


def lag_features(series: DataFrame, lags: int = 4) -> DataFrame:
    """Columns lag_1..lag_n; weeks without all of them are dropped."""
    names = {f"lag_{i}": F.lag("y", i).over(_by_week()) for i in range(1, lags + 1)}
    return series.withColumns(names).na.drop(subset=list(names))


def differences(series: DataFrame) -> DataFrame:
    first = series.withColumn("diff_1", F.col("y") - F.lag("y").over(_by_week()))
    return first.withColumn("diff_2", F.col("diff_1") - F.lag("diff_1").over(_by_week()))


def with_differences_as_series(series: DataFrame) -> DataFrame:
    """Level, first and second difference as three long series: series_key, transform, week, value."""
    wide = differences(series).select(
        "series_key", "week", F.col("y").cast("double").alias("level"),
        F.col("diff_1").cast("double").alias("diff_1"), F.col("diff_2").cast("double").alias("diff_2"),
    )
    long = wide.unpivot(["series_key", "week"], ["level", "diff_1", "diff_2"], "transform", "value")
    return long.where(F.col("value").isNotNull())


def chronological_split(series: DataFrame, held_out: Column) -> DataFrame:
    """Adds split = fit/validate; the last `held_out` weeks of each series validate.

    `held_out` may use the column n, the length of the series.
    """
    sized = series.withColumns({
        "n": F.count("*").over(Window.partitionBy("series_key")), "_row": F.row_number().over(_by_week())
    })
    late = F.col("_row") > F.col("n") - held_out
    return sized.withColumn("split", F.when(late, "validate").otherwise("fit")).drop("n", "_row")


# Right-tail critical values of the level-stationarity statistic.
KPSS_TABLE = [(0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01)]
MIN_TEST_POINTS = 10


def kpss(long: DataFrame) -> DataFrame:
    """KPSS test around a constant with the automatic lag choice, per (series_key, transform)."""
    ordered = F.array_sort(F.collect_list(F.struct("week", "value")))
    arrays = (
        long.groupBy("series_key", "transform").agg(ordered.alias("points"), F.avg("value").alias("mean"))
        .withColumn("n", F.size("points")).where(F.col("n") >= MIN_TEST_POINTS)
        .withColumn("e", F.transform("points", lambda p: p["value"] - F.col("mean")))
    )
    n = F.col("n").cast("double")
    # Auto-products at lag i: the sum of e[t] * e[t-i].
    products = "aggregate(sequence({i}, n - 1), 0D, (acc, t) -> acc + e[t] * e[t - {i}])"
    by_lag = (
        arrays.withColumn("m", F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int"))
        .withColumn("c0", F.expr(products.format(i=0)))
        .withColumn("c", F.expr(f"transform(sequence(1, m), i -> {products.format(i='i')} / (n / 2D))"))
        .withColumn("s0", F.col("c0") / n + F.aggregate("c", F.lit(0.0), lambda a, x: a + x))
        .withColumn("s1", F.expr("aggregate(sequence(1, m), 0D, (acc, i) -> acc + i * c[i - 1])"))
    )
    ratio = F.col("s1") / F.col("s0")
    chosen = F.floor(F.lit(1.1447) * F.pow(ratio * ratio, F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0)))
    weighted = f"aggregate(sequence(1, lags), 0D, (acc, i) -> acc + (1D - i / (lags + 1D)) * {products.format(i='i')})"
    scored = (
        by_lag.withColumn("lags", F.least(chosen.cast("int"), F.col("n") - 1))
        .withColumn("long_run", F.expr(f"(c0 + 2D * if(lags > 0, {weighted}, 0D)) / n"))
        .withColumn("squares", F.expr(
            "aggregate(e, struct(0D as s, 0D as q), (a, x) -> struct(a.s + x, a.q + (a.s + x) * (a.s + x)), a -> a.q)"
        ))
        .withColumn("statistic", F.try_divide("squares", n * n * F.col("long_run")))
    )
    return scored.select(
        "series_key", "transform", F.col("n").alias("observations"), "lags", "statistic",
        _interpolated("statistic").alias("p_value"),
    )


def _interpolated(statistic: str) -> Column:
    s = F.col(statistic)
    p = F.when(s <= KPSS_TABLE[0][0], KPSS_TABLE[0][1])
    for (x1, p1), (x2, p2) in zip(KPSS_TABLE, KPSS_TABLE[1:]):
        p = p.when(s <= x2, F.lit(p1) + (s - x1) / (x2 - x1) * (p2 - p1))
    return F.when(s.isNotNull(), p.otherwise(KPSS_TABLE[-1][1]))


def lag_one_forecast(series: DataFrame, start: str = TEST_START) -> DataFrame:
    """Last week's value as the forecast of the test weeks: the yardstick of every model."""
    lagged = series.withColumn("prediction", F.lag("y").over(_by_week()))
    return split_by_date(lagged, start).where("split = 'test' and prediction is not null").select(
        "series_key", F.lit("lag_1").alias("model"), "week", "y", "prediction"
    )
