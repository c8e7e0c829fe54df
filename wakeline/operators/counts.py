"""Counts and distributions of reports. All are partial aggregates: a hot key never gathers its rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.constants import EXCLUDED_CLASSES, CLASS_SAMPLE_ROWS
from wakeline.functions import time


def class_counts(df: DataFrame) -> DataFrame:
    return df.where(F.col("Type").isNotNull()).groupBy("Type").agg(F.count("*").alias("rows"))


def class_quota(
    df: DataFrame, total: int = CLASS_SAMPLE_ROWS, excluded: list[int] = EXCLUDED_CLASSES
) -> DataFrame:
    """Rows per class and the even share of a fixed sample that every kept class may fill."""
    counts = class_counts(df).where(~F.col("Type").isin(excluded))
    # One row per type code: the unpartitioned window sees at most a few hundred rows.
    classes = F.expr("count(*) over ()")
    return counts.withColumn("quota", F.floor(F.lit(total) / classes).cast("bigint"))


def vessel_types_by_year(df: DataFrame) -> DataFrame:
    """Vessels per type and year, each MMSI counted once with the type of its first report."""
    first = df.groupBy("year", "MMSI").agg(F.min_by("Type", "id").alias("Type"))
    counted = first.where(F.col("Type").isNotNull())
    return counted.groupBy("year", "Type").agg(F.count("*").alias("vessels")).orderBy("year", F.desc("vessels"), "Type")


def messages_daily(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "date").agg(F.count("*").alias("messages"))


def messages_hourly(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys, "hour").agg(F.count("*").alias("messages"))


def messages_by_weekday(df: DataFrame) -> DataFrame:
    return df.groupBy(time.weekday_name("timestamp").alias("weekday")).agg(F.count("*").alias("messages"))


def traffic_by_country(df: DataFrame) -> DataFrame:
    return df.groupBy("year", "Country").agg(
        F.count("*").alias("messages"), F.count_distinct("MMSI").alias("vessels")
    )


def distinct_values(df: DataFrame, column: str | Column) -> DataFrame:
    """Sorted distinct years, dates or vessels."""
    return df.select(column).distinct().orderBy(column)
