"""Session defaults and the shared checkpoint folder."""

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wakeline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_base(context: SparkContext) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a temporary one on a single machine and an
    error on a cluster, whose executors would write where nobody else can read."""
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="wakeline-checkpoint-")
        context.setCheckpointDir(base)
    return base


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared folder, so a lost executor costs no recomputation."""
    shared_base(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def small_side(keys: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Key table for a join: broadcast when counted and found small, shuffled otherwise.

    The keys are stored first, so counting them does not compute them twice.
    """
    stored = checkpointed(keys)
    return F.broadcast(stored) if stored.count() <= limit else stored


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, shuffle files go as soon as their query has ended; else they stay until the driver happens to collect its garbage.

    For queries that are stored, checkpointed or collected once. The session's own setting comes back afterwards.
    """
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
