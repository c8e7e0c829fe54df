"""Exact order statistics that never sort or gather a whole group in one task.

`exact_quantiles` starts from (value, count) pairs. Each round spreads the pairs of the still
possible intervals over equal-width cells, adds up the cells (at most `cells` rows per interval)
and keeps only the cells that hold a wanted rank. The last step ranks the pairs of those cells.

`sketched_quantiles` starts from raw rows. A mergeable sketch per key names an interval around every
wanted rank; one pass counts the rows before and between the intervals exactly and collapses only the
values inside. The counts say whether the interval holds the rank; if one does not, all are widened. So
what is shuffled follows the sketches and the few values around the ranks, and the answer is exact.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wakeline.session import checkpointed

CELLS = 16384
SKETCH_SIZE = 1024
#: Widths of the intervals to both sides, in shares of the rows. A sketch of this size names a rank within 0.0045
#: in 99 of 100 cases; the last width is the whole range.
MARGINS = (0.01, 0.1, 1.0)


def value_counts(long: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return long.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def exact_quantiles(
    counts: DataFrame,
    keys: list[str],
    probabilities: list[float],
    value: str = "value",
    cells: int = CELLS,
    rounds: int = 1,
) -> DataFrame:
    """Linearly interpolated quantiles of weighted values: keys, probability, quantile.

    `counts` has the columns keys, value and n; `keys` must be few (columns, years, types). Take
    more rounds when the distinct values of one key go into the billions.
    """
    intervals = (
        counts.groupBy(*keys)
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum("n").alias("total"))
        .select(*keys, "lo", "hi", F.lit(0).cast("bigint").alias("base"), _asks(probabilities).alias("asks"))
    )
    return _from_intervals(counts, intervals, keys, value, cells, rounds)


def sketch(value: Column) -> Column:
    """The aggregate that `sketched_quantiles` wants of every key."""
    return F.kll_sketch_agg_double(value, F.lit(SKETCH_SIZE))


def sketched_quantiles(
    long: DataFrame, summary: DataFrame, keys: list[str], probabilities: list[float], margins: tuple[float, ...] = MARGINS
) -> DataFrame:
    """Linearly interpolated quantiles of the column `value` of raw rows: keys, probability, quantile.

    `summary` has one row per key with the columns count, min, max and sketch of the values; it is read
    several times and must be stored, and small enough to broadcast. Null values take no part.
    """
    rows = long.where(F.col("value").isNotNull())
    known = summary.where("count > 0")
    for margin in margins:
        brackets = _brackets(known, keys, probabilities, margin)
        names = [c for c in brackets.columns if c not in keys]
        met = rows.join(F.broadcast(brackets), keys)
        pairs = list(zip(names[::2], names[1::2]))
        passed = sum((F.coalesce((F.col("value") > F.col(hi)).cast("int"), F.lit(0)) for _, hi in pairs), F.lit(0))
        held = F.lit(False)
        for lo, hi in pairs:
            held = held | F.coalesce(F.col("value").between(F.col(lo), F.col(hi)), F.lit(False))
        met = met.select(*keys, passed.alias("region"), F.when(held, F.col("value")).alias("value"))
        # In order: the rows before an interval as one row without a value, then the interval's values.
        counts = checkpointed(met.groupBy(*keys, "region", "value").agg(F.count("*").alias("n")))
        intervals = checkpointed(_held_ranks(counts, known, keys, probabilities))
        if margin >= 1 or not intervals.where("missed").head(1):
            break
    inside = counts.where(F.col("value").isNotNull()).drop("region")
    return _from_intervals(inside, intervals.drop("missed"), keys, "value", CELLS, 1)


def _brackets(summary: DataFrame, keys: list[str], probabilities: list[float], margin: float) -> DataFrame:
    """lo0, hi0, lo1, ... per key: disjoint intervals in ascending order, null where there are fewer."""
    # Keys of few rows take their whole range: there a rank's neighbour lies outside the margin.
    few = F.col("count") * margin < 8
    found = []
    for p in sorted(probabilities):
        lo, hi = (F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(p + d, 0.0), 1.0))) for d in (-margin, margin))
        lo = F.col("min") if p <= margin else F.when(few, F.col("min")).otherwise(lo)
        hi = F.col("max") if p >= 1 - margin else F.when(few, F.col("max")).otherwise(hi)
        found.append(F.struct(lo.alias("lo"), hi.alias("hi")))
    kind = "array<struct<lo:double,hi:double>>"

    def joined(done: Column, b: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        wider = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], b["hi"]).alias("hi"))
        apart = (F.size(done) == 0) | (b["lo"] > last["hi"])
        return F.when(apart, F.concat(done, F.array(b))).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(wider)))

    merged = summary.select(*keys, F.aggregate(F.array(*found), F.array().cast(kind), joined).alias("b"))
    parts = [F.get("b", F.lit(i))[side].alias(f"{side}{i}") for i in range(len(probabilities)) for side in ("lo", "hi")]
    return merged.select(*keys, *parts)


def _held_ranks(counts: DataFrame, summary: DataFrame, keys: list[str], probabilities: list[float]) -> DataFrame:
    """Intervals with the number of rows before them and the wanted ranks they hold.

    ``missed`` marks a key one of whose ranks no interval holds.
    """
    value = F.col("value")
    regions = counts.groupBy(*keys, "region").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("rows"), F.sum(F.when(value.isNull(), F.col("n")).otherwise(0)).alias("before"))
    # A key has at most one region more than probabilities.
    order = Window.partitionBy(*keys).orderBy("region")
    regions = regions.withColumn("start", F.sum("rows").over(order) - F.col("rows"))
    regions = regions.withColumn("base", F.col("start") + F.col("before")).withColumn("end", F.col("start") + F.col("rows"))
    wanted = F.broadcast(summary.select(*keys, F.col("count").alias("total")).select(*keys, _asks(probabilities).alias("asks")))
    # An interval without values starts where it ends and holds no rank.
    held = F.filter("asks", lambda a: (a["rank"] >= F.col("base")) & (a["rank"] < F.col("end")))
    found = regions.join(wanted, keys).withColumn("held", held)
    total = F.sum(F.size("held")).over(Window.partitionBy(*keys))
    return found.select(*keys, "lo", "hi", "base", F.col("held").alias("asks"), (total < F.size("asks")).alias("missed")).where("missed or size(asks) > 0")


def _asks(probabilities: list[float]) -> Column:
    """The two ranks around each probability, of ``total`` rows."""
    position = {p: (F.col("total") - 1) * F.lit(float(p)) for p in probabilities}
    return F.array(*[
        F.struct(
            F.lit(float(p)).alias("probability"),
            F.lit(upper).alias("upper"),
            F.least(F.floor(position[p]) + upper, F.col("total") - 1).cast("bigint").alias("rank"),
            (position[p] - F.floor(position[p])).alias("fraction"),
        )
        for p in probabilities for upper in (0, 1)
    ])


def _from_intervals(counts: DataFrame, intervals: DataFrame, keys: list[str], value: str, cells: int, rounds: int) -> DataFrame:
    for _ in range(rounds):
        intervals = _narrow(counts, intervals, keys, value, cells)

    low, high = (F.max(F.when(F.col("upper") == u, F.col(value))) for u in (0, 1))
    return (
        _answered(_inside(counts, intervals, keys, value), keys, value, "n")
        .groupBy(*keys, "probability").agg(low.alias("low"), high.alias("high"), F.max("fraction").alias("fraction"))
        .select(*keys, "probability", (F.col("low") + (F.col("high") - F.col("low")) * F.col("fraction")).alias("quantile"))
    )


def _cell(value: str, cells: int) -> Column:
    width = F.col("hi") - F.col("lo")
    spread = F.floor((F.col(value) - F.col("lo")) / width * cells)
    return F.when(width > 0, F.least(spread, F.lit(cells - 1))).otherwise(0).cast("int")


def _inside(counts: DataFrame, intervals: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pairs inside an interval. A key has at most two intervals per probability: broadcast them."""
    within = F.col(value).between(F.col("lo"), F.col("hi"))
    return counts.join(F.broadcast(intervals), keys).where(within)


def _answered(rows: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """Rows whose cumulative weight covers a wanted rank, one copy per rank they answer."""
    running = Window.partitionBy(*keys, "lo", "hi", "base").orderBy(order)
    ends = rows.withColumn("end", F.col("base") + F.sum(weight).over(running))
    covered = F.filter(
        "asks", lambda a: (a["rank"] < F.col("end")) & (a["rank"] >= F.col("end") - F.col(weight))
    )
    return ends.withColumn("ask", F.explode(covered)).select("*", "ask.*")


def _narrow(counts: DataFrame, intervals: DataFrame, keys: list[str], value: str, cells: int) -> DataFrame:
    sums = (
        _inside(counts, intervals, keys, value)
        .groupBy(*keys, "lo", "hi", "base", _cell(value, cells).alias("cell"))
        .agg(
            F.sum("n").alias("n"), F.min(value).alias("cell_lo"), F.max(value).alias("cell_hi"),
            F.first("asks").alias("asks"),
        )
    )
    held = _answered(sums, keys, "cell", "n")
    return (
        held.groupBy(*keys, F.col("cell_lo").alias("lo"), F.col("cell_hi").alias("hi"), (F.col("end") - F.col("n")).alias("base"))
        .agg(F.collect_list("ask").alias("asks"))
    )
