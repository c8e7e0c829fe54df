"""Stored schemas and column checks."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

POSITION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("MMSI", T.LongType()),
    T.StructField("Latitude", T.DoubleType()),
    T.StructField("Longitude", T.DoubleType()),
    T.StructField("Distance", T.DoubleType()),
    T.StructField("Bearing", T.DoubleType()),
    T.StructField("Type", T.IntegerType()),
])

TRACK_KEYS = ["track_year", "MMSI"]


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Raise KeyError when a column is absent; looks at the schema only."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df


def numeric_columns(df: DataFrame, drop: tuple[str, ...] = ("year", "MMSI", "id", "hour")) -> DataFrame:
    """Numeric columns only, without identifiers and calendar parts."""
    keep = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in drop]
    return df.select(*keep)
