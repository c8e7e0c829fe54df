"""Per-vessel tracks and reporting-interval statistics.

A track is the set of reports of one (track_year, MMSI). One vessel may hold a large share of all
rows, so no step sorts or gathers the rows of a track: sizes are partial aggregates, and gaps are
taken within days first and across days second.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wakeline.constants import GAP_THRESHOLDS, SMALL_TRACK_ROWS, TRACK_SIZE_THRESHOLDS, WEEKDAYS
from wakeline.functions import time
from wakeline.operators.quantiles import exact_quantiles
from wakeline.schema import TRACK_KEYS, require_columns
from wakeline.session import small_side


def track_sizes(df: DataFrame, small: int = SMALL_TRACK_ROWS) -> DataFrame:
    """Rows, modal type (smallest on ties) and size class of every track of two rows or more."""
    require_columns(df, *TRACK_KEYS, "Type")
    by_type = df.groupBy(*TRACK_KEYS, "Type").agg(F.count("*").alias("n"))
    # Among equal counts the smaller type wins: order by (n, -Type). Null types do not vote.
    vote = F.when(F.col("Type").isNotNull(), F.struct(F.col("n"), -F.col("Type")))
    sizes = by_type.groupBy(*TRACK_KEYS).agg(
        F.sum("n").alias("rows"), F.max_by("Type", vote).alias("modal_type")
    )
    size_class = F.when(F.col("rows") <= small, "small").otherwise("large")
    return sizes.where(F.col("rows") > 1).withColumn("size_class", size_class)


def tracks(df: DataFrame) -> DataFrame:
    """Reports that belong to a track: those of vessels with more than one row in the year.

    Only the keys of single-row vessels are joined. They are counted first: while they are few the
    reports are not shuffled at all; beyond that the join is a shuffle, whose hot keys the
    adaptive skew join splits.
    """
    keyed = df.where(F.col("MMSI").isNotNull())
    singles = keyed.groupBy(*TRACK_KEYS).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return keyed.join(small_side(singles), TRACK_KEYS, "left_anti")


def tracks_of_size(df: DataFrame, size_class: str, small: int = SMALL_TRACK_ROWS) -> DataFrame:
    """Rows of the small (up to ten rows) or of the large tracks."""
    wanted = track_sizes(df, small).where(F.col("size_class") == size_class).select(*TRACK_KEYS)
    return df.join(small_side(wanted), TRACK_KEYS, "left_semi")


def new_tracks(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of tracks the store does not hold yet."""
    return df.join(small_side(stored.select(*TRACK_KEYS).distinct()), TRACK_KEYS, "left_anti")


def saved_and_skipped(df: DataFrame, stored: DataFrame) -> DataFrame:
    """How many tracks would be written and how many are already there."""
    held = stored.select(*TRACK_KEYS).distinct().withColumn("held", F.lit(True))
    marked = df.select(*TRACK_KEYS).distinct().join(held, TRACK_KEYS, "left")
    return marked.agg(
        F.count_if(F.col("held").isNull()).alias("saved"), F.count_if(F.col("held")).alias("skipped")
    )


def track_size_thresholds(df: DataFrame, thresholds: list[int] = TRACK_SIZE_THRESHOLDS) -> DataFrame:
    sizes = track_sizes(df).agg(*[F.count_if(F.col("rows") > t).alias(str(t)) for t in thresholds])
    return sizes.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(str(t)).alias("tracks")) for t in thresholds
    ])))


def reporting_gaps(df: DataFrame) -> DataFrame:
    """Mean and sample variance of the seconds between successive reports of each track.

    Equal seconds are counted first (their gaps are zero), which bounds a track's day by 86400
    rows and a track by its days. Sums stay exact integers until the last division.
    """
    seconds = (
        df.where(F.col("MMSI").isNotNull() & F.col("timestamp").isNotNull())
        .withColumn("day", F.floor(F.col("timestamp") / F.lit(time.DAY)))
        .groupBy(*TRACK_KEYS, "day", "timestamp").agg(F.count("*").alias("n"))
    )
    within = Window.partitionBy(*TRACK_KEYS, "day").orderBy("timestamp")
    step = F.col("timestamp") - F.lag("timestamp").over(within)
    days = (
        seconds.withColumn("gap", F.coalesce(step, F.lit(0)))
        .groupBy(*TRACK_KEYS, "day")
        .agg(
            F.sum("n").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
            F.sum(F.col("gap") * F.col("gap")).alias("squares"),
        )
    )
    across = Window.partitionBy(*TRACK_KEYS).orderBy("day")
    jump = F.coalesce(F.col("first") - F.lag("last").over(across), F.lit(0))
    totals = days.withColumn("jump", jump).groupBy(*TRACK_KEYS).agg(
        (F.sum("n") - 1).alias("gaps"),
        (F.max("last") - F.min("first")).alias("span"),
        F.sum(F.col("squares") + F.col("jump") * F.col("jump")).alias("squares"),
    )
    gaps, span, squares = (F.col(c).cast("double") for c in ("gaps", "span", "squares"))
    return totals.where("gaps >= 2 and span > 0").select(
        *TRACK_KEYS,
        (F.col("gaps") + 1).alias("rows"),
        (span / gaps).alias("mean_s"),
        ((squares - span * span / gaps) / (gaps - 1.0)).alias("variance_s2"),
    )


def gap_threshold_census(gaps: DataFrame) -> DataFrame:
    """Tracks whose mean gap lies below, at or above each threshold, in three units and one pass."""
    cells, aggregates = [], []
    for unit, seconds, thresholds in GAP_THRESHOLDS:
        mean = F.col("mean_s") / F.lit(float(seconds))
        for t in thresholds:
            limit, name = F.lit(float(t)), f"{unit}_{t}"
            aggregates += [
                F.count_if(mean < limit).alias(f"{name}_less"),
                F.count_if(mean == limit).alias(f"{name}_equal"),
                F.count_if(mean > limit).alias(f"{name}_greater"),
            ]
            cells.append(F.struct(
                F.lit(unit).alias("unit"), F.lit(t).alias("threshold"),
                *[F.col(f"{name}_{side}").alias(side) for side in ("less", "equal", "greater")],
            ))
    return gaps.agg(*aggregates).select(F.inline(F.array(*cells)))


def box_stats(sizes: DataFrame) -> DataFrame:
    """Quartiles of track length per type and the whisker ends within 1.5 interquartile ranges."""
    counts = (
        sizes.groupBy(F.col("modal_type").alias("Type"), F.col("rows").cast("double").alias("value"))
        .agg(F.count("*").alias("n")).where(F.col("Type").isNotNull())
    )
    quartiles = exact_quantiles(counts, ["Type"], [0.25, 0.5, 0.75]).groupBy("Type").agg(*[
        F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name)
        for name, p in {"q1": 0.25, "median": 0.5, "q3": 0.75}.items()
    ])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    # One row per type code, so the quartiles are small enough to broadcast.
    return (
        counts.join(F.broadcast(quartiles), "Type")
        .where(F.col("value").between(F.col("q1") - reach, F.col("q3") + reach))
        .groupBy("Type", "q1", "median", "q3")
        .agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))
    )


def week_by_weekday(df: DataFrame) -> DataFrame:
    """Reports per weekday of every ISO week, zeros included, with the week's most frequent month."""
    months = df.groupBy(
        time.iso_year("timestamp").alias("iso_year"), time.iso_week("timestamp").alias("iso_week"),
        time.utc_month("timestamp").alias("month"), time.weekday_name("timestamp").alias("weekday"),
    ).agg(F.count("*").alias("n"))
    # At most seven rows per week reach the next step.
    by_month = months.groupBy("iso_year", "iso_week", "month").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("weekday") == d, F.col("n")).otherwise(0)).alias(d) for d in WEEKDAYS]
    )
    weeks = by_month.groupBy("iso_year", "iso_week").agg(
        F.max_by("month", F.struct(F.col("n"), -F.col("month"))).alias("month"),
        *[F.sum(d).alias(d) for d in WEEKDAYS],
    )
    return weeks.unpivot(["iso_year", "iso_week", "month"], WEEKDAYS, "weekday", "messages")
