"""Map layers as GeoJSON tables: one feature per row, ready to be written per day or per year."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wakeline.constants import ANTENNA_LAT, ANTENNA_LON, FOCUS_AREA
from wakeline.operators.prepare import in_bearing_sector, popup, with_coordinates

POPUP = ["MMSI", "Type", "Latitude", "Longitude", "datetime", "Country"]


def _feature(geometry: Column, properties: Column) -> Column:
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")
    ))


def _point(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def map_points(df: DataFrame, period: str, popup_fields: list[str] = POPUP) -> DataFrame:
    """Points of every period with the colour index of their type and the popup text.

    Colours number the types present in a period. The distinct (period, type) pairs are ranked on
    their own and joined back by value, so a busy day is not sorted.
    """
    located = with_coordinates(df)
    present = located.select(period, "Type").distinct()
    colours = present.withColumn(
        "colour", F.dense_rank().over(Window.partitionBy(period).orderBy(F.col("Type").asc_nulls_first())) - 1
    ).select(F.col(period).alias("_period"), F.col("Type").alias("_type"), "colour")
    same = (F.col(period) == F.col("_period")) & F.col("Type").eqNullSafe(F.col("_type"))
    return located.join(colours, same).select(
        period, "id", "Longitude", "Latitude", "Type", "colour", popup(popup_fields).alias("popup")
    )


def daily_map_points(df: DataFrame) -> DataFrame:
    return map_points(df, "date")


def bearing_map_points(df: DataFrame) -> DataFrame:
    """The south-western sector, by year; the popup also shows the bearing."""
    return map_points(in_bearing_sector(df), "year", [*POPUP, "Bearing"])


def point_features(points: DataFrame, period: str) -> DataFrame:
    """Points as GeoJSON features: (period, feature)."""
    return points.select(period, _feature(
        _point(F.col("Longitude"), F.col("Latitude")), F.struct("id", "Type", "colour", "popup")
    ).alias("feature"))


def fixed_features(spark: SparkSession, zones: DataFrame | None = None) -> DataFrame:
    """The parts every map shares: focus area, antenna and, when given, the port zones (name, ring)."""
    ring = F.array(F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in FOCUS_AREA]))
    polygon = F.struct(F.lit("Polygon").alias("type"), ring.alias("coordinates"))
    antenna = _point(F.lit(ANTENNA_LON), F.lit(ANTENNA_LAT))
    named = [(polygon, "Area of Focus"), (antenna, "Antenna AIS")]
    features = spark.range(1).select(F.explode(F.array(*[
        _feature(g, F.struct(F.lit(name).alias("name"))) for g, name in named
    ])).alias("feature"))
    if zones is None:
        return features
    drawn = F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))
    return features.unionByName(zones.select(_feature(drawn, F.struct("name")).alias("feature")))


def map_layer(points: DataFrame, period: str, zones: DataFrame | None = None) -> DataFrame:
    """Point features of every period together with the shared parts (period null)."""
    shared = fixed_features(points.sparkSession, zones)
    return point_features(points, period).unionByName(shared, allowMissingColumns=True)
