"""Readers of raw report dumps and CSV folders. Every read is split by Spark; nothing passes the driver."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeline.schema import POSITION

# A statement ends with a semicolon at the end of a line.
STATEMENT_END = r";[ \t\r]*(?:\n|$)"
# Quoted text with backslash escapes.
QUOTED = r"'(?:[^'\\]++|\\.)*+'"
TUPLE = rf"(?s)\(((?:[^()'\\]++|\\.|{QUOTED})*+)\)"
FIELD = rf"(?s)((?:[^,'\\]++|\\.|{QUOTED})*+)(?:,|$)"


def _typed(text: Column, field: T.StructField) -> Column:
    """Value of a text field; NULL, empty and unreadable text become null, 12.0 is an integer."""
    clean = F.nullif(F.regexp_replace(F.trim(text), "^'+|'+$", ""), F.lit("NULL"))
    if isinstance(field.dataType, T.DoubleType):
        value = clean.try_cast("double")
        typed = F.when(~F.isnan(value), value)
    else:
        kind = field.dataType.simpleString()
        typed = F.coalesce(clean.try_cast(kind), clean.try_cast("double").try_cast(kind))
    return typed.alias(field.name)


def read_dumps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reports in the INSERT statements of SQL dumps, with the year of the file name as dump_year.

    Statements may run over several lines; other statements and comments are skipped. One
    statement is one input row, so dumps should be written with bounded INSERTs (as they are by
    default).
    """
    text = spark.read.option("lineSep", ";\n").text(paths)
    year = F.regexp_extract("_metadata.file_name", r"(\d{4})", 1).try_cast("int")
    statements = text.select(
        year.alias("dump_year"), F.explode(F.split("value", STATEMENT_END)).alias("statement")
    )
    values = F.regexp_extract("statement", r"(?s)(?:^|\n)\s*INSERT INTO\b.*?\bVALUES\b(.*)$", 1)
    records = statements.where(F.col("statement").contains("INSERT INTO")).select(
        "dump_year", F.explode(F.regexp_extract_all(values, F.lit(TUPLE), F.lit(1))).alias("record")
    )
    fields = records.select("dump_year", F.regexp_extract_all("record", F.lit(FIELD), F.lit(1)).alias("field"))
    return fields.select(
        *[_typed(F.get("field", F.lit(i)), f) for i, f in enumerate(POSITION.fields)], "dump_year"
    )


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    year: int | str | None = None,
    schema: T.StructType = POSITION,
) -> DataFrame:
    """All .csv files of a folder with a fixed schema, plus source_file.

    `year` keeps the files whose name contains it, before any of them is opened. Raises
    FileNotFoundError when no file is left.
    """
    pattern = f"*{year}*.csv" if year is not None else "*.csv"
    if _listing(spark, path, pattern).isEmpty():
        raise FileNotFoundError(f"no CSV files matching {pattern} in {path}")
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    rows = (
        spark.read.schema(texts).option("header", True).option("enforceSchema", False)
        .option("nullValue", "NULL").option("pathGlobFilter", pattern).csv(path)
    )
    return rows.select(
        *[_typed(F.col(f.name), f) for f in schema.fields], F.col("_metadata.file_name").alias("source_file")
    )


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one CSV per vessel and year; both keys come from the file name."""
    schema = T.StructType([f for f in POSITION.fields if f.name != "MMSI"])
    rows = read_csv(spark, path, schema=schema)
    year = F.regexp_extract("source_file", r"(\d{4})_[^_]*$", 1).try_cast("int")
    mmsi = F.regexp_extract("source_file", r"_([^_.]+)\.[^_]*$", 1).try_cast("double").cast("bigint")
    return rows.withColumns({"track_year": year, "MMSI": mmsi})


def _listing(spark: SparkSession, path: str | list[str], pattern: str) -> DataFrame:
    """File paths only: the content column is never selected, so no file is read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")


def first_files(spark: SparkSession, path: str, n: int) -> list[str]:
    """The n first CSV files by name, for a trial run on part of the data."""
    rows = _listing(spark, path, "*.csv").orderBy("path").limit(n).collect()
    return [r["path"] for r in rows]


def first_sources(df: DataFrame, source: str, n: int) -> DataFrame:
    """Rows of the n first sources of a table that names them in a column."""
    chosen = df.select(source).where(F.col(source).isNotNull()).distinct().orderBy(source).limit(n)
    return df.join(F.broadcast(chosen), source, "left_semi")
