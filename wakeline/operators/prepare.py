"""Cleaning and enrichment of position reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.constants import BEARING_SECTOR, EXCLUDED_CLASSES, EXCLUDED_MMSI, FOCUS_AREA, UNKNOWN
from wakeline.functions import geo, identity, time
from wakeline.schema import require_columns

# Three-digit codes bound the flag dimension, whatever file it comes from.
MAX_FLAG_CODES = 1000


def in_focus_area(df: DataFrame, ring: list[tuple[float, float]] = FOCUS_AREA) -> DataFrame:
    require_columns(df, "Longitude", "Latitude")
    return df.where(geo.in_polygon("Longitude", "Latitude", ring))


def real_vessels(df: DataFrame, numbers: list[int] = EXCLUDED_MMSI) -> DataFrame:
    require_columns(df, "MMSI")
    return df.where(~identity.is_excluded("MMSI", numbers=numbers))


def without_listed(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Exclusion by a list held in a table of column MMSI; null MMSIs stay."""
    return df.join(listed.select("MMSI").distinct(), "MMSI", "left_anti")


def in_bearing_sector(df: DataFrame, low: float = BEARING_SECTOR[0], high: float = BEARING_SECTOR[1]) -> DataFrame:
    """Reports of a closed sector that also have coordinates."""
    return df.where(
        F.col("Bearing").between(low, high) & ~F.isnan("Bearing")
        & F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull()
    )


def with_coordinates(df: DataFrame) -> DataFrame:
    return df.na.drop(subset=["Longitude", "Latitude"])


def usable_classes(df: DataFrame, excluded: list[int] = EXCLUDED_CLASSES) -> DataFrame:
    return df.where(F.col("Type").isNotNull() & ~F.col("Type").isin(excluded))


def with_time_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "datetime": time.utc_datetime("timestamp"),
        "date": time.utc_date("timestamp"),
        "year": time.utc_year("timestamp"),
        "hour": time.utc_hour("timestamp"),
    })


def with_country(df: DataFrame, flags: DataFrame) -> DataFrame:
    """Flag state by MID; codes without an entry become Unknown.

    The dimension is reduced to its three-character codes, of which there are at most a thousand
    numeric ones, so it is small enough to send to every executor.
    """
    codes = (
        flags.where(F.col("code").rlike("^[0-9]{1,3}$"))
        .groupBy(F.col("code").alias("MID")).agg(F.min("country").alias("Country"))
    )
    joined = df.withColumn("MID", identity.mid("MMSI")).join(F.broadcast(codes), "MID", "left")
    return joined.withColumn("Country", F.coalesce("Country", F.lit(UNKNOWN)))


def prepared(df: DataFrame, flags: DataFrame, numbers: list[int] = EXCLUDED_MMSI) -> DataFrame:
    """Clean reports with calendar parts and flag: the input of every statistic. Cheap test first."""
    kept = df.transform(real_vessels, numbers).transform(in_focus_area)
    return kept.transform(with_time_parts).transform(with_country, flags)


def filter_audit(df: DataFrame, numbers: list[int] = EXCLUDED_MMSI) -> DataFrame:
    """Row counts before and after each filter, in one pass."""
    area = geo.in_polygon("Longitude", "Latitude")
    vessel = ~identity.is_excluded("MMSI", numbers=numbers)
    stages = {"all": F.lit(True), "focus_area": area, "focus_area_and_identity": area & vessel}
    counts = df.agg(*[F.count_if(c).alias(s) for s, c in stages.items()])
    return counts.unpivot([], list(stages), "stage", "rows")


def popup(fields: list[str]) -> Column:
    """Text shown at a map point: one `name: value` per line."""
    parts = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit("nan"))) for f in fields]
    return F.concat_ws("<br>", *parts)


def distance_km(metres: Column | str) -> Column:
    return (F.col(metres) if isinstance(metres, str) else metres) / 1000.0
