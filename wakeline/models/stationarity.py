"""Augmented Dickey-Fuller test with a constant, lag chosen by AIC, for many series at once.

A series is one array, bounded by the calendar. The cross products of the level, a constant and the
lagged steps are summed once on the rows that all lag orders share; a lag order is a leading part of that
matrix, solved by itself. The chosen order is fitted again on all rows it can use.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.functions.arrays import computed, differenced, dot, gram, let, normal_probability, solve, total
from wakeline.operators.series import MIN_TEST_POINTS

# MacKinnon (2010) response surface of the 1, 5 and 10 % values for a constant; powers of 1/T.
CRITICAL = {
    "crit_1": (-3.43035, -6.5393, -16.786, -79.433),
    "crit_5": (-2.86154, -2.8903, -4.234, -40.040),
    "crit_10": (-2.56677, -1.5384, -2.809, 0.0),
}
# MacKinnon (1994) p-value polynomials below and above the switch point, and their limits.
SMALL_P = (2.1659, 1.4412, 0.038269)
LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
SWITCH, LOWEST, HIGHEST = -1.61, -18.83, 2.74


def p_value(statistic: Column) -> Column:
    def polynomial(terms: tuple[float, ...]) -> Column:
        return sum((F.lit(c) * F.pow(statistic, F.lit(float(i))) for i, c in enumerate(terms)), F.lit(0.0))

    z = F.when(statistic <= SWITCH, polynomial(SMALL_P)).otherwise(polynomial(LARGE_P))
    return F.when(statistic > HIGHEST, 1.0).when(statistic < LOWEST, 0.0).otherwise(normal_probability(z))


def _regressors(value: Column, step: Column, lags: Column, start: Column) -> Column:
    """Level, constant and the lagged steps, for the rows from `start` steps on; the last column is the step itself."""
    rows = F.size(step) - start
    level = F.slice(value, start + 1, rows)
    back = F.when(lags > 0, F.transform(F.sequence(F.lit(1), F.greatest(lags, F.lit(1))), lambda i: F.slice(step, start + 1 - i, rows))).otherwise(
        F.array().cast("array<array<double>>"))
    return F.concat(F.array(level, F.transform(level, lambda _: F.lit(1.0))), back, F.array(F.slice(step, start + 1, rows)))


def _solved(products: Column, size: Column) -> Column:
    """Coefficients, the inverse's first diagonal value and the squared error, from the first ``size`` regressors' products.

    The products' last row is that of the step.
    """
    own = F.transform(F.slice(products, 1, size), lambda row: F.slice(row, 1, size))
    right = F.transform(F.slice(products, 1, size), lambda row, i: F.array(F.element_at(row, -1), F.when(i == 0, 1.0).otherwise(0.0)))
    return let(solve(own, right), lambda found: F.struct(
        F.get(F.get(found, F.lit(0)), F.lit(0)).alias("slope"), F.get(F.get(found, F.lit(0)), F.lit(1)).alias("inverse"),
        (F.element_at(F.element_at(products, -1), -1) - dot(F.transform(found, lambda x: F.get(x, F.lit(0))), F.transform(right, lambda x: F.get(x, F.lit(0))))).alias("sse"),
    ))


def adf(long: DataFrame, most_lags: int | None = None) -> DataFrame:
    """One row per (series_key, transform) of at least ten varying points; ``most_lags`` bounds the lag order."""
    ordered = F.array_sort(F.collect_list(F.struct("week", "value")))
    rows = long.groupBy("series_key", "transform").agg(ordered.alias("points")).where(F.size("points") >= MIN_TEST_POINTS)
    rows = rows.select("series_key", "transform", F.transform("points", lambda p: p["value"].cast("double")).alias("v")).repartition("series_key", "transform")
    rows = rows.where(F.array_max("v") > F.array_min("v"))
    # The statistic does not change when a constant is taken off; the products then keep their digits.
    rows = computed(rows, mean=total(F.col("v")) / F.size("v"))
    n = F.size("v")
    usual = F.least(F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 2).cast("int")
    most = usual if most_lags is None else F.least(usual, F.lit(most_lags))
    rows = computed(rows, level=F.transform("v", lambda x: x - F.col("mean")), step=differenced(F.col("v")), most=most)
    level, step = F.col("level"), F.col("step")
    rows = computed(rows, products=gram(_regressors(level, step, F.col("most"), F.col("most"))))
    count = F.size("step") - F.col("most")

    def aic(lags: Column) -> Column:
        sse = F.greatest(_solved(F.col("products"), lags + 2)["sse"], F.lit(1e-300))
        return F.struct((count * F.log(sse / count) + 2 * (lags + 2)).alias("aic"), lags.alias("lags"))

    orders = F.filter(F.transform(F.sequence(F.lit(0), F.col("most")), aic), lambda o: o["aic"].isNotNull())
    rows = computed(rows, lags=F.array_min(orders)["lags"]).where(F.col("lags").isNotNull())
    rows = computed(rows, own=gram(_regressors(level, step, F.col("lags"), F.col("lags"))), observations=F.size("step") - F.col("lags"))
    rows = computed(rows, fit=_solved(F.col("own"), F.col("lags") + 2))
    variance = F.col("fit.sse") / (F.col("observations") - F.col("lags") - 2)
    rows = computed(rows, statistic=F.try_divide(F.col("fit.slope"), F.sqrt(F.greatest(variance * F.col("fit.inverse"), F.lit(0.0)))))
    rows = rows.where(F.col("statistic").isNotNull())
    critical = [sum((F.lit(c) / F.pow(F.col("observations").cast("double"), F.lit(float(i))) for i, c in enumerate(t)), F.lit(0.0)).alias(name) for name, t in CRITICAL.items()]
    return rows.select("series_key", "transform", "observations", "lags", "statistic", p_value(F.col("statistic")).alias("p_value"), *critical)
