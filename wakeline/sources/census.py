"""File counts per processing stage and year, to check that every stage produced its files."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from wakeline.constants import YEARS

FEW_FILES = 10


def list_files(spark: SparkSession, folders: dict[str, str]) -> DataFrame:
    """(stage, name) of the files directly in each stage's folder; a missing folder has none."""
    empty = spark.createDataFrame([], "stage string, name string")
    found = []
    for stage, folder in folders.items():
        try:
            files = spark.read.format("binaryFile").load(folder).select("path")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        found.append(files.select(F.lit(stage).alias("stage"), F.substring_index("path", "/", -1).alias("name")))
    return reduce(DataFrame.unionByName, found, empty)


def census(files: DataFrame, stages: list[str], years: list[int] = YEARS) -> DataFrame:
    """Files per stage and year substring, and in total (year null); zero for stages without files.

    A name counts for every year it contains, wherever it stands in the name.
    """
    flags = [F.count_if(F.col("name").contains(str(y))).alias(str(y)) for y in years]
    counted = files.groupBy("stage").agg(*flags, F.count("*").alias("all"))
    wanted = files.sparkSession.createDataFrame([(s,) for s in stages], "stage string")
    rows = [F.struct(F.lit(y).alias("year"), F.col(str(y)).alias("files")) for y in years]
    rows.append(F.struct(F.lit(None).cast("int").alias("year"), F.col("all").alias("files")))
    full = F.broadcast(wanted).join(counted, "stage", "left").na.fill(0)
    return full.select("stage", F.inline(F.array(*rows)))


def names_of_small_stages(files: DataFrame, fewer_than: int = FEW_FILES) -> DataFrame:
    small = files.groupBy("stage").agg(F.count("*").alias("n")).where(F.col("n") < fewer_than)
    return files.join(small.select("stage"), "stage", "left_semi")
