"""Intermediate tables in the folder that driver and executors share."""

import uuid

from pyspark.sql import DataFrame, SparkSession

from wakeline.session import shared_base


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share; see ``session.shared_base``."""
    return f"{shared_base(spark.sparkContext).rstrip('/')}/wakeline-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, columns stay prunable."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
