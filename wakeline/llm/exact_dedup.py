"""Exact duplicates by sorting contents, with DataFrame functions only.

Every normalised text goes to the range partition of its leading characters and digest; the
splitters are sampled by Spark and have a bounded length. Within a partition an external sort puts
equal texts next to each other, and a window whose key is the whole text compares neighbours in
full. Identifiers are sorted behind the text, so the first row of a run is the one that stays.

Skew: a text with more rows than an eighth of a range's share is found by counting digests first.
There are at most eight of those per range, so their list has a proven bound. Its rows are
spread over slices of the range by their identifiers; every slice leaves one head, and the heads of
a text are compared in full again, as few rows as there are slices.

Defined results: a null text counts as empty; a null identifier sorts behind all others; of rows
with the same text and identifier exactly one is kept; an empty table gives no rows; other columns
take no part, whatever their names.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.storage import stored

HEAD_CHARS = 16
SHARE = 8
SLICES = 4


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``ranges`` is the number of range partitions, the session's shuffle partitions if not given.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), normalised(F.col(text)).alias("content"))
    runs = _runs(rows, ranges or _default(docs), F.col("content"))
    size = F.count("*").over(_same().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    runs = runs.select("id", "digest", "slice", "place", "first_id", size.alias("size"), _head_text().alias("content"))
    runs = stored(runs, "exact")
    best = _best(runs).drop("content")
    cold = runs.where("slice = 0").select("id", "digest", F.col("first_id").alias("keep"), "size", (F.col("place") == 1).alias("kept"))
    hot = runs.where("slice > 0").join(best, ["digest", "slice"]).select(
        "id", "digest", "keep", F.col("total").alias("size"), ((F.col("place") == 1) & F.col("wins")).alias("kept"),
    )
    return cold.unionByName(hot).select(
        F.col("id").alias(id_column), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_column: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """The input rows that stay, with all their columns; whole rows travel through the same sort."""
    rows = docs.select(
        F.col(id_column).cast("long").alias("id"), normalised(F.col(text)).alias("content"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
    )
    runs = _runs(rows, ranges or _default(docs), normalised(F.col(f"row.`{text}`")))
    heads = stored(runs.where("place = 1").select("row", "digest", "slice", "first_id", F.lit(1).alias("size"), _head_text().alias("content")), "heads")
    best = _best(heads).where("wins").select("digest", "slice")
    hot = heads.where("slice > 0").join(best, ["digest", "slice"], "left_semi")
    return heads.where("slice = 0").select("row.*").unionByName(hot.select("row.*"))


def _default(docs: DataFrame) -> int:
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _same():
    return Window.partitionBy("head", "digest", "slice", "content").orderBy(F.col("id").asc_nulls_last())


def _head_text() -> Column:
    return F.when((F.col("slice") > 0) & (F.col("place") == 1), F.col("content"))


def _runs(rows: DataFrame, ranges: int, content: Column) -> DataFrame:
    """Rows in content order with their place in the run of equal texts and the run's first id.

    Rows that carry their whole source are shipped without the normalised copy of the text.
    """
    rows = rows.withColumn("digest", F.unhex(F.sha2("content", 256)))
    hot = _frequent(rows, ranges)
    slices = F.pmod(F.xxhash64("id"), F.lit(ranges * SLICES)) + 1
    rows = rows.join(F.broadcast(hot), "digest", "left")
    rows = rows.withColumn("head", F.substring("content", 1, HEAD_CHARS))
    rows = rows.withColumn("slice", F.when(F.col("frequent"), slices).otherwise(F.lit(0))).drop("frequent")
    if "row" in rows.columns:
        rows = rows.drop("content")
    ranged = rows.repartitionByRange(ranges, "head", "digest", "slice").withColumn("content", content)
    return ranged.withColumn("place", F.row_number().over(_same())).withColumn("first_id", F.first("id").over(_same()))


def _frequent(rows: DataFrame, ranges: int) -> DataFrame:
    """Digests with more than 1 / (8 x ranges) of all rows: fewer than 8 x ranges of them."""
    counts = stored(rows.groupBy("digest").agg(F.count("*").alias("n")), "digests")
    limit = counts.agg((F.sum("n") / (SHARE * ranges)).alias("share"))
    least = F.greatest(F.col("share"), F.lit(float(SLICES)))
    return counts.crossJoin(F.broadcast(limit)).where(F.col("n") > least).select("digest", F.lit(True).alias("frequent"))


def _best(runs: DataFrame) -> DataFrame:
    """(digest, slice, content, keep, total, wins) of the slices of frequent texts, compared in full."""
    heads = runs.where("content is not null").select("digest", "slice", "content", "first_id", "size")
    order = F.struct(F.col("first_id").isNull().alias("last"), F.col("first_id").alias("id"), F.col("slice").alias("slice"))
    best = heads.groupBy("digest", "content").agg(F.min(order).alias("best"), F.sum("size").alias("total"))
    return heads.join(best, ["digest", "content"]).select(
        "digest", "slice", "content", F.col("best.id").alias("keep"), "total", (F.col("slice") == F.col("best.slice")).alias("wins"),
    )
