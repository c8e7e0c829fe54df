"""Algebra on small arrays of doubles as Column expressions: series, cross products, linear systems.

Arrays here are weekly series, bounded by the calendar, and matrices of a few lags.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that are computed once a row.

    Behind a generator the optimizer cannot copy their formulas into every place that reads them.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def lagged(x: Column, n: int) -> Column:
    """The values n places earlier, zeros before the first."""
    return let(x, lambda v: F.slice(F.concat(F.array_repeat(F.lit(0.0), n), v), F.lit(1), F.size(v)))


def differenced(x: Column, n: int = 1) -> Column:
    """Differences over n places; the first n places are left out."""
    return F.zip_with(F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0))), F.slice(x, 1, F.greatest(F.size(x) - n, F.lit(0))), lambda a, b: a - b)


def before(x: Column, n: int) -> Column:
    """The n-th value from the end, zero where there is none."""
    return F.coalesce(F.get(x, F.size(x) - n), F.lit(0.0))


def moving(x: Column, c: Column, n: int) -> Column:
    """x[t] - c * x[t - n]."""
    return let(x, lambda v: F.zip_with(v, lagged(v, n), lambda a, b: a - c * b))


def recursive(x: Column, c: Column, n: int) -> Column:
    """y[t] = x[t] - c * y[t - n]."""
    empty = F.array().cast("array<double>")
    return F.aggregate(x, empty, lambda y, v: F.concat(y, F.array(v - c * before(y, n))))


def gram(columns: Column) -> Column:
    """All cross products of an array of equally long arrays."""
    return let(columns, lambda m: F.transform(m, lambda a: F.transform(m, lambda b: dot(a, b))))


def solve(matrix: Column, right: Column) -> Column:
    """Solutions of matrix * x = right, row by row, by Gauss-Jordan elimination; null values where singular.

    The matrix is positive definite, as cross products are, so no rows change places. ``right`` has a row
    per equation and a column per system.
    """
    def eliminate(m: Column, k: Column) -> Column:
        pivot = let(F.get(m, k), lambda row: F.transform(row, lambda v: F.try_divide(v, F.get(row, k))))
        return let(pivot, lambda p: F.transform(m, lambda row, i: F.when(i == k, p).otherwise(F.zip_with(row, p, lambda a, b: a - F.get(row, k) * b))))

    whole = F.zip_with(matrix, right, lambda a, b: F.concat(a, b))
    reduced = let(whole, lambda m: F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), m, eliminate))
    return let(reduced, lambda m: F.transform(m, lambda row: F.slice(row, F.size(m) + 1, F.size(row) - F.size(m))))


def regression(columns: Column, target: Column) -> Column:
    """Least-squares coefficients of the target on the columns."""
    return let(columns, lambda m: let(target, lambda y: F.flatten(solve(gram(m), F.transform(m, lambda c: F.array(dot(c, y)))))))


def combination(columns: Column, weights: Column) -> Column:
    """Sum of the columns by their weights."""
    scaled = F.zip_with(columns, weights, lambda c, w: F.transform(c, lambda v: v * w))
    first = F.transform(F.get(columns, F.lit(0)), lambda v: v * 0.0)
    return F.aggregate(scaled, first, lambda s, c: F.zip_with(s, c, lambda a, b: a + b))


def normal_probability(z: Column) -> Column:
    """Standard normal distribution function, by its power series around zero."""
    inner = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    zero = F.struct(inner.alias("term"), inner.alias("sum"))

    def add(s: Column, k: Column) -> Column:
        term = s["term"] * inner * inner / (2 * k + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(160)), zero, add, lambda s: s["sum"])
    return 0.5 + series * F.exp(-0.5 * inner * inner) / F.sqrt(2 * F.pi())
