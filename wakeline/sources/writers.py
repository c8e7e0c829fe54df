"""Sinks: chunked files, the focus-area set, the track store and result tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from wakeline.constants import EXCLUDED_MMSI_ML, ROWS_PER_FILE
from wakeline.operators.prepare import in_focus_area, real_vessels
from wakeline.operators.tracks import new_tracks, saved_and_skipped, tracks
from wakeline.schema import TRACK_KEYS


#: Buckets of the track table; a table of terabytes wants thousands.
TRACK_BUCKETS = 64


def write_chunks(df: DataFrame, path: str, rows: int = ROWS_PER_FILE, by: str | None = None) -> None:
    """CSV files of at most `rows` rows each, in a folder per value of `by` when given."""
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def write_focus_area(df: DataFrame, path: str) -> None:
    """Reports inside the area from real vessels, as Parquet in one folder per source file."""
    kept = df.transform(real_vessels, EXCLUDED_MMSI_ML).transform(in_focus_area)
    kept.write.mode("overwrite").partitionBy("source_file").parquet(path)


def write_table(df: DataFrame, path: str, by: str | None = None, form: str = "parquet") -> None:
    """Result table, in one folder per value of `by` when given (a year, a date)."""
    writer = df.write.mode("overwrite").format(form)
    if form == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(by) if by else writer).save(path)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_tracks(df: DataFrame, path: str) -> dict[str, int]:
    """Add the tracks the store lacks; returns how many were saved and skipped.

    Rows are range-partitioned on vessel and time, so one vessel with very many reports spreads
    over several files instead of one task, and files stay sorted by vessel and time.
    """
    found = tracks(df)
    stored = read_store(df.sparkSession, path)
    if stored is None:
        stored = df.sparkSession.createDataFrame([], "track_year int, MMSI bigint")
    outcome = saved_and_skipped(found, stored).first().asDict()
    (
        new_tracks(found, stored)
        .repartitionByRange(*TRACK_KEYS, "timestamp")
        .sortWithinPartitions(*TRACK_KEYS, "timestamp")
        .write.mode("append").partitionBy("track_year").parquet(path)
    )
    return outcome


def write_track_table(df: DataFrame, name: str, path: str | None = None, buckets: int = TRACK_BUCKETS) -> None:
    """The tracks as a table bucketed by year and vessel and sorted by time within them.

    Sizes, gaps and the anti join against the table then read each bucket where it lies, without an exchange. A
    vessel's year is one bucket's rows: a transmitter's reporting rate bounds it to a few million. Where one key
    can hold more, `append_tracks` spreads it over files by time instead.
    """
    sorted_ = tracks(df).repartition(buckets, *TRACK_KEYS)
    writer = sorted_.write.mode("overwrite").bucketBy(buckets, *TRACK_KEYS).sortBy(*TRACK_KEYS, "timestamp")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def stored_track_keys(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*[F.col(k) for k in TRACK_KEYS]).distinct()


def write_results(tables: dict[str, DataFrame], path: str) -> None:
    """Every result table of a run below one path; tables with a year are stored by year."""
    for name, table in tables.items():
        write_table(table, f"{path}/{name}", by="year" if "year" in table.columns else None)
