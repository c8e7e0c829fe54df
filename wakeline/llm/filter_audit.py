"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Every filter becomes one stored relation of the row numbers that fail it. A chain is a prefix of
filters followed by one more, and what happens at a step depends on the set of filters before it and
not on their order. So there is one relation of (filter, prefix, row): the rows themselves under
"no filter" and, by a left-semi join each, the rows that fail a filter. For every filter in turn the
relation is doubled into "not in the prefix" and "in the prefix", and a left-anti join takes out the
rows of the second kind that fail it. What stays under "no filter" are a prefix's survivors; what
stays under a filter is removed by it directly behind that prefix. All joins are on the row number, so
the relation is dealt out once and the doubled rows are never shuffled, only counted.

Five filters give 32 prefixes; the doubling is bounded by that number, not by the data.

Defined results: a null text is empty; a null part is the empty string; a null identifier is larger
than all others and equal to no other, so that a null row fails E beside any identified copy and two
null copies do not fail it; rows with one identifier and text do not fail E through each other; every
row of a repeated identifier counts and has that identifier's labels; a label counts if any label row
of the identifier has it; an empty table gives no rows. Other columns are not read, whatever their names.
"""

import json
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.llm.storage import stored

SPACE = r"[\x20\x09-\x0D]+"
NONE = -1
#: A text with more than this share of a shuffle partition's rows is met by a broadcast.
SHARE = 8


def measured(docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Stored rows (row, id, part, digest, A, B, C, D) of all documents; the texts are read once."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), "")).withColumn("n", F.size("words"))
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", ""))
    return stored(rows.select(
        "row", "id", "part", F.unhex(F.sha2("text", 256)).alias("digest"),
        (F.col("n") < 50).alias("A"),
        (F.lit(100) * F.size(F.array_distinct("words")) < F.lit(65) * F.col("n")).alias("B"),
        (F.lit(100).cast("long") * capitals > F.lit(5).cast("long") * F.char_length("text")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    ), "measured")


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows whose digest also belongs to a smaller id.

    Identifiers are counted by digest first. The digests that hold more than an eighth of a
    partition's rows are fewer than eight per partition: they are broadcast, the others are joined.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1 and first is not null")
    groups = stored(groups, "copies")
    limit = rows.count() / (SHARE * parts)
    later = F.col("id").isNull() | (F.col("id") > F.col("first"))
    keys = rows.select("row", "id", "digest")
    hot = F.broadcast(groups.where(F.col("n") > limit).select("digest", "first"))
    cold = groups.where(F.col("n") <= limit).select("digest", "first")
    found = keys.join(hot, "digest").where(later).select("row")
    rest = keys.join(hot, "digest", "left_anti").join(cold, "digest").where(later).select("row")
    return found.unionByName(rest)


def failing_rows(rows: DataFrame) -> dict[str, DataFrame]:
    """One stored relation of failing row numbers per filter of the audited chain."""
    tables = {name: rows.where(name).select("row") for name in "ABCD"} | {"E": later_copies(rows)}
    return {name: stored(table, f"fails-{name}") for name, table in tables.items()}


def labelled(rows: DataFrame, labels: DataFrame, id_column: str = "doc_id", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(row, part, good, toxic) with both marks as 0 or 1. Rows without an identifier are dealt out by row number."""
    yes = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    marks = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("key")).agg(
        yes(quality).alias("good"), yes(toxic).alias("toxic"), F.lit(False).alias("lone"))
    marks = marks.where("good = 1 or toxic = 1")
    keyed = rows.select("row", "part", F.coalesce("id", "row").alias("key"), F.col("id").isNull().alias("lone"))
    joined = keyed.join(marks, ["key", "lone"], "left")
    return joined.select("row", "part", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def prefix_counts(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """(part, filter, prefix, n, good, toxic): survivors under filter -1, else what that filter removes behind the prefix.

    ``rows`` has row, part, good and toxic; a prefix is the sum of 2 ** i over its filters, numbered
    in the order of their names.
    """
    names = sorted(failing)
    fails = [rows.join(failing[name], "row", "left_semi").withColumn("filter", F.lit(i)) for i, name in enumerate(names)]
    relation = reduce(DataFrame.unionByName, fails, rows.withColumn("filter", F.lit(NONE))).withColumn("prefix", F.lit(0))
    for i, name in enumerate(names):
        bit = F.lit(1 << i)
        both = F.array("prefix", F.col("prefix").bitwiseOR(bit))
        relation = relation.withColumn("prefix", F.explode(F.when(F.col("filter") == i, F.array("prefix")).otherwise(both)))
        failed = failing[name].select(F.col("row").alias("failed"))
        gone = (F.col("row") == F.col("failed")) & (F.col("prefix").bitwiseAND(bit) != 0)
        relation = relation.join(failed, gone, "left_anti")
    return relation.groupBy("part", "filter", "prefix").agg(
        F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def steps(names: list[str]) -> Column:
    """Array of (filter_order, step, filter, prefix) for every order of the filters."""
    rows = []
    for order in permutations(range(len(names))):
        prefix = 0
        for at, i in enumerate(order):
            rows.append({"filter_order": "".join(names[x] for x in order), "step": at + 1, "filter": i, "prefix": prefix})
            prefix |= 1 << i
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,filter:int,prefix:int>>")


def audit(rows: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost
    and shapley, the removals of the step's filter summed over all orders.
    """
    names = sorted(failing)
    k, every = len(names), (1 << len(names)) - 1
    counts = prefix_counts(rows, failing)
    weights = F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)))
    # Only subsets without the filter itself are there, so the number of filters before it is below k.
    orders = F.when(F.col("filter") >= 0, F.col("n") * F.get(weights, F.bit_count("prefix"))).otherwise(0)
    key = (F.col("filter") + 1) * (every + 1) + F.col("prefix")
    by_part = counts.groupBy("part").agg(
        F.map_from_entries(F.collect_list(F.struct(key.alias("key"), F.struct("n", "good", "toxic").alias("value")))).alias("at"),
        F.array(*(F.sum(F.when(F.col("filter") == i, orders).otherwise(0)) for i in range(k))).alias("shapley"),
    )
    s = by_part.select("part", "at", "shapley", F.explode(steps(names)).alias("s")).select("part", "at", "shapley", "s.*")

    def at(filter_: Column, prefix: Column, field: str) -> Column:
        return F.coalesce(F.col("at")[filter_ * (every + 1) + prefix][field], F.lit(0)).cast("long")

    own, bit = F.col("filter") + 1, F.expr("shiftleft(1, filter)")
    return s.select(
        "part", "filter_order", "step", at(F.lit(0), F.col("prefix").bitwiseOR(bit), "n").alias("kept"),
        at(own, F.col("prefix"), "n").alias("removed"), (at(own, F.lit(0), "n") - at(own, F.col("prefix"), "n")).alias("redundant"),
        at(own, F.lit(every) - bit, "n").alias("unique_fails"), at(own, F.col("prefix"), "good").alias("good_lost"),
        at(own, F.col("prefix"), "toxic").alias("toxic_lost"), F.get("shapley", F.col("filter")).cast("long").alias("shapley"),
    )


def document_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five document filters A to E over sources."""
    rows = measured(docs)
    return audit(stored(labelled(rows, labels), "labelled"), failing_rows(rows))
