"""Dated URL lists: entries become validity intervals, captures meet those active at fetch time.

An entry is a dated change of one list: a pattern is added or removed. Patterns are hosts, domains
(the host and all its subdomains) or prefixes of host and path. The changes of a pattern, in order,
give half-open intervals. A capture has one key per pattern that could match it; keys and months
make an equi-join, and the fetch time decides inside the month, which is the as-of join without
sorting any host's captures in one task. Skewed hosts are left to the adaptive skew join.

Defined results: of changes at the same instant an addition wins; repeated additions and removals
change nothing; a capture without URL, host or time matches nothing; repeated captures each get a
row; without entries nothing matches; other columns pass through, clashing ones are replaced.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.llm.storage import stored

FOREVER = "9999-12-31 00:00:00"


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty where there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(authority), r"\.$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, valid_from, valid_to) from (list, kind, pattern, action, changed_at)."""
    key = ["list", "kind", "pattern"]
    changes = entries.where("pattern is not null and changed_at is not null and action in ('add', 'remove')")
    changes = changes.groupBy(*key, "changed_at").agg(F.max(F.col("action") == "add").alias("active"))
    order = Window.partitionBy(*key).orderBy("changed_at")
    turns = changes.withColumn("before", F.lag("active").over(order))
    turns = turns.where(F.col("active") != F.coalesce(F.col("before"), F.lit(False)))
    spans = turns.withColumn("valid_to", F.coalesce(F.lead("changed_at").over(order), F.lit(FOREVER).cast("timestamp")))
    return spans.where("active").select(*key, F.col("changed_at").alias("valid_from"), "valid_to")


def keys(url: Column) -> Column:
    """All (kind, pattern) pairs that match the URL, as array of structs."""
    labels = F.split(host(url), r"\.")
    depth = F.when(host(url) == "", 0).otherwise(F.size(labels))
    parents = F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, depth), "."))
    steps = F.filter(F.split(path(url), "/"), lambda s: s != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda i: F.concat(host(url), F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")),
    )
    found = F.concat(
        F.array(F.struct(F.lit("host").alias("kind"), host(url).alias("pattern"))),
        F.transform(parents, lambda p: F.struct(F.lit("domain").alias("kind"), p.alias("pattern"))),
        F.transform(F.array_distinct(prefixes), lambda p: F.struct(F.lit("prefix").alias("kind"), p.alias("pattern"))),
    )
    return F.when(host(url) != "", found).otherwise(F.slice(found, F.lit(1), F.lit(0)))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """The captures with n_block, n_allow, since and verdict.

    ``since`` is the latest start among the active block entries. A capture is blocked when an entry of
    a list named block is active and none of a list named allow is.
    """
    added = ["n_block", "n_allow", "since", "verdict"]
    rows = stored(captures.drop(*added, "_row").withColumn("_row", F.monotonically_increasing_id()), "captures")
    month = lambda t: F.year(t) * 12 + F.month(t)
    last = rows.agg(F.max(fetched).alias("last"))
    spans = intervals(entries).join(F.broadcast(last)).where("valid_from <= last")  # one row
    spans = spans.select(
        "list", "kind", "pattern", "valid_from", "valid_to",
        F.explode(F.sequence(month(F.col("valid_from")), month(F.least("valid_to", "last")))).alias("month"),
    )
    wanted = rows.where(F.col(fetched).isNotNull()).select(
        "_row", F.col(fetched).alias("fetched"), month(F.col(fetched)).alias("month"), F.explode(keys(F.col(url))).alias("key"),
    ).select("_row", "fetched", "month", "key.kind", "key.pattern")
    met = wanted.join(spans, ["kind", "pattern", "month"]).where("valid_from <= fetched and fetched < valid_to")
    sums = met.groupBy("_row").agg(
        F.sum((F.col("list") == "block").cast("long")).alias("n_block"),
        F.sum((F.col("list") == "allow").cast("long")).alias("n_allow"),
        F.max(F.when(F.col("list") == "block", F.col("valid_from"))).alias("since"),
    )
    out = rows.join(sums, "_row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    verdict = F.when((F.col("n_block") > 0) & (F.col("n_allow") == 0), "blocked").otherwise("allowed")
    return out.select(*[c for c in rows.columns if c != "_row"], zero("n_block"), zero("n_allow"), "since", F.coalesce(verdict, F.lit("allowed")).alias("verdict"))
