"""Equal-width histograms and density curves, one per key (normally per year)."""

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENSITY_POINTS = 200
#: Bin width and reach of a kernel in bandwidths, and the order of its expansion. Half a bin is 1/8, so the
#: first term left out is below 1e-11 of the kernel's height; beyond the reach a kernel is below 1e-17.
BIN, REACH, ORDER = 0.25, 9.0, 9


def _ranges(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Range of the values per key, widened by half a unit when all are equal.

    Keys are calendar years, so this side of the join stays below a few hundred thousand rows
    even for nonsense timestamps, and can be broadcast.
    """
    limits = df.groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"),
        F.stddev_samp(value).alias("_std"),
    )
    flat = F.col("_lo") == F.col("_hi")
    return limits.withColumns({
        "lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")),
        "hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")),
    })


def histogram(df: DataFrame, keys: list[str], value: Column | str, bins: int) -> DataFrame:
    """Non-empty bins over [min, max] with their edges; the last bin is closed on the right."""
    x = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, x.cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ranges = _ranges(rows, keys, F.col("x")).select(*keys, "lo", "hi")
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    counted = (
        rows.join(F.broadcast(ranges), keys)
        .groupBy(*keys, "lo", "hi", index.alias("bin")).agg(F.count("*").alias("rows"))
    )
    return counted.select(
        *keys, "bin",
        (F.col("lo") + F.col("bin") * width).alias("lower"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
        "rows",
    )


def polar_histogram(df: DataFrame, keys: list[str], degrees: str, bins: int = 360) -> DataFrame:
    """Histogram of an angle in radians."""
    return histogram(df, keys, F.radians(F.col(degrees)), bins)


def density(df: DataFrame, keys: list[str], value: str, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density on an even grid over [min, max], Scott's bandwidth.

    Values are binned on a grid of a quarter of the bandwidth, and a bin keeps the power sums of its
    values' distances from its centre. A kernel is expanded around the centre in Hermite polynomials, so
    a bin acts on a grid point through those few sums and the result is the exact sum to about eleven digits.
    Only bins are shuffled, at most (range / bandwidth * 4) per key whatever the number of
    distinct values, and a bin meets only the points within ``REACH`` bandwidths.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    spread = _ranges(rows, keys, F.col("x")).where(F.col("_std") > 0).select(
        *keys,
        F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_n").alias("n"),
        (F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).alias("bandwidth"),
    )
    group = [*keys, "lo", "hi", "n", "bandwidth"]
    bins = _binned(rows.join(F.broadcast(spread), keys), group)
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    first, last = (F.floor((F.col("centre") + s * REACH * F.col("bandwidth") - F.col("lo")) / step).cast("int") for s in (-1, 1))
    reached = F.sequence(F.greatest(first, F.lit(0)), F.least(last + 1, F.lit(points - 1)))
    location = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    # A column of its own, so that the polynomials do not repeat it.
    met = bins.withColumn("point", F.explode(reached)).withColumn("u", (location - F.col("centre")) / F.col("bandwidth"))
    u = F.col("u")
    expanded = sum((F.get("powers", F.lit(k)) / factorial(k) * _hermite(k, u) for k in range(1, ORDER + 1)), F.get("powers", F.lit(0)))
    on_grid = met.select(*group, "point", (expanded * F.exp(-0.5 * u * u)).alias("part"))
    # Points that no bin reaches are there too, with a density of zero.
    nothing = spread.select(*group, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), F.lit(0.0).alias("part"))
    summed = on_grid.unionByName(nothing).groupBy(*group, "point").agg(F.sum("part").alias("total"))
    norm = F.col("n") * F.col("bandwidth") * F.sqrt(F.lit(2.0) * F.pi())
    return summed.select(*keys, "point", location.alias("location"), (F.greatest("total", F.lit(0.0)) / norm).alias("density"))


def _binned(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key and non-empty bin: its centre and the power sums of (x - centre) / bandwidth."""
    width = F.col("bandwidth") * BIN
    rows = rows.withColumn("bin", F.floor((F.col("x") - F.col("lo")) / width))
    rows = rows.withColumn("centre", F.col("lo") + (F.col("bin") + 0.5) * width)
    v = (F.col("x") - F.col("centre")) / F.col("bandwidth")
    rows, powers = rows.withColumn("v1", v), [F.count("*").cast("double")]
    for k in range(2, ORDER + 1):
        rows = rows.withColumn(f"v{k}", F.col(f"v{k - 1}") * F.col("v1"))
    powers += [F.sum(f"v{k}") for k in range(1, ORDER + 1)]
    return rows.groupBy(*keys, "bin", "centre").agg(F.array(*powers).alias("powers"))


def _hermite(order: int, u: Column) -> Column:
    """The Hermite polynomial of probability theory, by Horner's rule."""
    before, now = [0], [1]  # coefficients from the highest power down
    for k in range(order):
        lower = [0] * (len(now) + 1 - len(before)) + [k * c for c in before]
        before, now = now, [a - b for a, b in zip([*now, 0], lower)]
    out = F.lit(float(now[0]))
    for c in now[1:]:
        out = out * u + float(c)
    return out
