"""Small dimension tables: flag states and port zones."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.constants import LOCAL_FLAGS, PORT_ZONES


def local_flags(spark: SparkSession) -> DataFrame:
    """Flags of the covered sea; pass the full ITU list through `read_flags` for world-wide traffic."""
    return spark.createDataFrame(LOCAL_FLAGS, "code string, country string")


def read_flags(spark: SparkSession, path: str) -> DataFrame:
    """Flag list from a CSV file of code,country with a header."""
    return spark.read.schema("code string, country string").option("header", True).csv(path)


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """Port zones from a GeoJSON feature collection of polygons: name, outer ring, and all rings with the holes."""
    schema = (
        "features array<struct<properties: struct<name: string>, "
        "geometry: struct<coordinates: array<array<array<double>>>>>>"
    )
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("features"))
    return features.select(F.col("properties.name").alias("name"), F.col("geometry.coordinates")[0].alias("ring"), F.col("geometry.coordinates").alias("rings"))


def port_zones(spark: SparkSession) -> DataFrame:
    """The ports of the covered sea as zones (name, ring, rings)."""
    rows = [(name, [list(p) for p in ring], [[list(p) for p in ring]]) for name, ring in PORT_ZONES.items()]
    return spark.createDataFrame(rows, "name string, ring array<array<double>>, rings array<array<array<double>>>")
