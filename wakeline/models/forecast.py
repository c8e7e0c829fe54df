"""Weekly traffic forecasts for many series at once.

Input is (series_key, week, y, split) with split train/test. A series is one array, bounded by the
calendar, and fits are Column expressions over it: cross products of lags, small linear systems and
recursions as array folds. So every series is a row and Spark spreads rows (and, for the smoothing
search, row x form x weights) over tasks. Output is one row per test week:
(series_key, model, week, y, prediction, aic, bic, note). A series a model cannot be fitted to
has null predictions and the reason in `note`.
"""

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.constants import SEASON_WEEKS
from wakeline.functions.arrays import before, combination, computed, differenced, dot, lagged, let, moving, recursive, regression, total
from wakeline.operators.evaluation import forecast_metrics
from wakeline.operators.scaling import minmax_scaled
from wakeline.operators.series import chronological_split, lag_features

COLUMNS = ["series_key", "model", "week", "y", "prediction", "aic", "bic", "note"]
MIN_POINTS = 10


def as_arrays(series: DataFrame, train: str = "train") -> DataFrame:
    """(series_key, y, n, test): the train values in the order of weeks, and the other weeks with their values."""
    def ordered(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition, F.struct("week", F.col("y").cast("double").alias("y")))))

    rows = series.groupBy("series_key").agg(ordered(F.col("split") == train).alias("fit"), ordered(F.col("split") != train).alias("test"))
    return rows.select("series_key", F.transform("fit", lambda p: p["y"]).alias("y"), F.size("fit").alias("n"), "test")


def _by_week(rows: DataFrame, model: Column) -> DataFrame:
    """One row per test week of rows with test, forecast, aic, bic and note."""
    weeks = rows.where(F.size("test") > 0).select("series_key", "aic", "bic", "note", "forecast", F.posexplode("test").alias("at", "p"))
    found = weeks.select("series_key", model.alias("model"), "p.week", "p.y", F.get("forecast", F.col("at")).alias("prediction"), "aic", "bic", "note")
    return found.select(*COLUMNS)


# --- ARIMA by conditional least squares -------------------------------------------------------

STEPS = (1.0, 0.5, 0.25, 0.0625, 0.0)
ROUNDS = 12
BOUND = 0.98


class _Model:
    """(1 - a B)(1 - A B^s) w = (1 + b B)(1 + B' B^s) e; without a season a and b only.

    Parameters are one array: a, b or a, A, b, B'. Nothing is before the first value.
    """

    def __init__(self, season: int | None):
        self.season = season
        self.size = 2 if season is None else 4

    def named(self, p: Column) -> tuple[Column, ...]:
        return tuple(F.get(p, F.lit(i)) for i in range(self.size))

    def shocks(self, x: Column, p: Column) -> Column:
        """x with the moving-average side taken off."""
        if self.season is None:
            return recursive(x, self.named(p)[1], 1)
        _, _, b, wide = self.named(p)
        return recursive(recursive(x, b, 1), wide, self.season)

    def errors(self, w: Column, p: Column) -> Column:
        if self.season is None:
            return self.shocks(moving(w, self.named(p)[0], 1), p)
        a, wide, _, _ = self.named(p)
        return self.shocks(moving(moving(w, a, 1), wide, self.season), p)

    def slopes(self, w: Column, e: Column, p: Column) -> Column:
        """The errors' derivatives, with the sign changed."""
        if self.season is None:
            return F.array(lagged(self.shocks(w, p), 1), lagged(recursive(e, self.named(p)[1], 1), 1))
        (a, wide, b, wide_b), s = self.named(p), self.season
        return F.array(
            lagged(self.shocks(moving(w, wide, s), p), 1), lagged(self.shocks(moving(w, a, 1), p), s),
            lagged(recursive(e, b, 1), 1), lagged(recursive(e, wide_b, s), s),
        )

    def start(self, w: Column) -> Column:
        """Two regressions: on lags alone for the errors, then on the lags of values and errors."""
        lags = [1, 2, 3, 4] if self.season is None else [1, 2, 3, 4, self.season, self.season + 1]
        long = F.array(*(lagged(w, n) for n in lags))
        errors = let(long, lambda x: F.zip_with(w, combination(x, regression(x, w)), lambda a, b: a - b))
        own = [1] if self.season is None else [1, self.season]
        second = let(errors, lambda e: regression(F.array(*(lagged(x, n) for x in (w, e) for n in own)), w))
        return F.transform(second, lambda v: F.coalesce(F.least(F.greatest(v, F.lit(-0.9)), F.lit(0.9)), F.lit(0.1)))

    def fit(self, w: Column) -> Column:
        """Gauss-Newton steps on the sum of squared errors, each shortened until it does not rise."""
        def nearer(p: Column, _: Column) -> Column:
            step = let(self.errors(w, p), lambda e: regression(self.slopes(w, e, p), e))

            def tried(d: Column) -> Column:
                options = F.transform(F.array(*map(F.lit, STEPS)), lambda h: F.zip_with(
                    p, d, lambda v, x: F.least(F.greatest(v + h * F.coalesce(x, F.lit(0.0)), F.lit(-BOUND)), F.lit(BOUND))))
                scored = F.transform(options, lambda o: F.struct(let(self.errors(w, o), lambda e: dot(e, e)).alias("sse"), o.alias("p")))
                return F.array_min(scored)["p"]

            return let(step, tried)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), self.start(w), nearer)

    def forecast(self, y: Column, w: Column, e: Column, p: Column, steps: Column) -> Column:
        s, named = self.season, self.named(p)

        def ahead(state: Column, _: Column) -> Column:
            w, e, y = state["w"], state["e"], state["y"]
            if s is None:
                a, b = named
                new, rise = a * before(w, 1) + b * before(e, 1), F.lit(0.0)
            else:
                a, wide, b, wide_b = named
                new = (a * before(w, 1) + wide * before(w, s) - a * wide * before(w, s + 1)
                       + b * before(e, 1) + wide_b * before(e, s) + b * wide_b * before(e, s + 1))
                rise = before(y, s) - before(y, s + 1)
            return let(new, lambda v: F.struct(
                F.concat(w, F.array(v)).alias("w"), F.concat(e, F.array(F.lit(0.0))).alias("e"), F.concat(y, F.array(before(y, 1) + rise + v)).alias("y")))

        zero = F.struct(w.alias("w"), e.alias("e"), y.alias("y"))
        return F.aggregate(F.sequence(F.lit(1), steps), zero, ahead, lambda state: F.slice(state["y"], F.size(y) + 1, steps))


def arima_fits(series: DataFrame, season: int | None = None) -> DataFrame:
    """One row per series: y, n, test, w (differenced), p (parameters), e (errors) and note; p is null where it has no fit."""
    model, needed = _Model(season), MIN_POINTS if season is None else 3 * season
    w = differenced(F.col("y")) if season is None else differenced(differenced(F.col("y")), season)
    rows = computed(as_arrays(series).repartition("series_key"), w=F.when(F.col("n") >= needed, w))
    note = F.when(F.col("n") < needed, F.concat(F.lit(f"needs {needed} weeks, has "), F.col("n").cast("string"))).when(
        F.array_max("w") == F.array_min("w"), "differenced series is constant")
    rows = computed(rows, note=note)
    rows = computed(rows, p=F.when(F.col("note").isNull(), model.fit(F.col("w"))))
    return computed(rows, e=F.when(F.col("p").isNotNull(), model.errors(F.col("w"), F.col("p"))))


def _arima(series: DataFrame, name: str, season: int | None) -> DataFrame:
    rows = arima_fits(series, season)
    w, e, p, n = F.col("w"), F.col("e"), F.col("p"), F.size("w")
    steps = F.size("test")
    deviance = n * (F.log(2 * F.pi() * F.greatest(dot(e, e), F.lit(1e-300)) / n) + 1)
    k = (2 if season is None else 4) + 1
    fitted = F.col("p").isNotNull() & (steps > 0)
    rows = computed(
        rows, forecast=F.when(fitted, _Model(season).forecast(F.col("y"), w, e, p, steps)),
        aic=F.when(fitted, deviance + 2 * k), bic=F.when(fitted, deviance + k * F.log(n)),
    )
    return _by_week(rows, F.lit(name))


def arima(series: DataFrame) -> DataFrame:
    """ARIMA(1,1,1)."""
    return _arima(series, "ARIMA_(1,1,1)", None)


def sarima(series: DataFrame, season: int = SEASON_WEEKS) -> DataFrame:
    """ARIMA(1,1,1), also (1,1,1) at the season's lag."""
    return _arima(series, f"SARIMAX_(1,1,1)x(1,1,1,{season})", season)


# --- Holt-Winters -----------------------------------------------------------------------------

FORMS = [("add", "add"), ("mul", "add"), ("add", "mul"), ("mul", "mul")]
GRID, REACH, SHRINK, SEARCHES = 5, 0.48, 3.0, 3
WEIGHTS = ("alpha", "beta", "gamma")


def smoothed(y: Column, m: int, growing: Column, factor: Column, weights: Column) -> Column:
    """The best of an array of weights (structs of alpha, beta, gamma): its weights, level, slope, season and squared error.

    ``growing`` and ``factor`` say whether trend and season are multiplied. All weights go through the weeks
    together: a state per weight, and a queue of seasonal places with a value per weight, the coming place
    first. A division by zero or an overflow takes a weight out; null if none is left.
    """
    def begin(first: Column) -> Column:
        second = total(F.slice(y, m + 1, m)) / m
        slope = F.when(growing, F.pow(F.try_divide(second, first), F.lit(1.0 / m))).otherwise((second - first) / m)
        states = F.transform(weights, lambda w: F.struct(
            w.alias("w"), first.alias("level"), slope.alias("slope"), F.lit(0.0).alias("sse"), F.lit(0.0).alias("place")))
        season = F.transform(F.slice(y, 1, m), lambda v: F.transform(weights, lambda _: F.when(factor, F.try_divide(v, first)).otherwise(v - first)))
        return F.struct(states.alias("states"), season.alias("season"))

    def week(all_: Column, value: Column) -> Column:
        def one(state: Column, s: Column) -> Column:
            base = F.when(growing, state["level"] * state["slope"]).otherwise(state["level"] + state["slope"])

            def after(b: Column) -> Column:
                error = value - F.when(factor, b * s).otherwise(b + s)
                alpha, beta, gamma = (state["w"][name] for name in WEIGHTS)
                level = alpha * F.when(factor, F.try_divide(value, s)).otherwise(value - s) + (1 - alpha) * b
                slope = beta * F.when(growing, F.try_divide(level, state["level"])).otherwise(level - state["level"]) + (1 - beta) * state["slope"]
                place = gamma * F.when(factor, F.try_divide(value, b)).otherwise(value - b) + (1 - gamma) * s
                return F.struct(state["w"].alias("w"), level.alias("level"), slope.alias("slope"), (state["sse"] + error * error).alias("sse"), place.alias("place"))

            return let(base, after)

        states = F.zip_with(all_["states"], F.get(all_["season"], F.lit(0)), one)
        return let(states, lambda new: F.struct(
            new.alias("states"), F.concat(F.slice(all_["season"], 2, m - 1), F.array(F.transform(new, lambda x: x["place"]))).alias("season")))

    def best(done: Column) -> Column:
        sound = F.filter(F.transform(done["states"], lambda x, i: F.struct(
            x["sse"].alias("sse"), i.alias("at"), x["w"].alias("weights"), x["level"].alias("level"), x["slope"].alias("slope"))),
            lambda x: x["sse"] < float("inf"))  # neither null nor NaN nor without bound
        return let(F.array_min(sound), lambda x: F.when(x.isNotNull(), F.struct(
            x["weights"].alias("weights"), x["level"].alias("level"), x["slope"].alias("slope"),
            F.transform(done["season"], lambda place: F.get(place, x["at"])).alias("season"), x["sse"].alias("sse"))))

    return let(total(F.slice(y, 1, m)) / m, lambda first: let(F.aggregate(y, begin(first), week), best))


def _one_weight(weights: tuple[float, float, float]) -> Column:
    return F.array(F.struct(*(F.lit(float(v)).alias(name) for name, v in zip(WEIGHTS, weights))))


def extended(state: Column, m: int, trend: Column, seasonal: Column, steps: Column) -> Column:
    """The forecasts of the coming weeks from a smoothing state."""
    def at(h: Column) -> Column:
        base = F.when(trend == "mul", state["level"] * F.pow(state["slope"], h)).otherwise(state["level"] + state["slope"] * h)
        cycle = F.get(state["season"], (h - 1) % m)
        return F.when(seasonal == "mul", base * cycle).otherwise(base + cycle)

    return F.transform(F.sequence(F.lit(1), steps), at)


def _near(centre: Column, reach: float) -> Column:
    """GRID values around a weight, inside (0, 1)."""
    offsets = [reach * (2.0 * i / (GRID - 1) - 1.0) for i in range(GRID)]
    return F.array(*(F.least(F.greatest(centre + d, F.lit(1e-4)), F.lit(1 - 1e-4)) for d in offsets))


def smoothing_search(rows: DataFrame, season: int) -> DataFrame:
    """Rows of (series_key, trend, seasonal, y) with the ``state`` of the least squared error.

    A grid over the three weights is refined around its best place. A row takes the whole grid through its
    series at once, so a search is a few expressions per row; null where the form does not suit.
    """
    names, keys = rows.columns, ["series_key", "trend", "seasonal"]
    suits = (F.size("y") >= 2 * season) & (((F.col("trend") == "add") & (F.col("seasonal") == "add")) | (F.array_min("y") > 0))
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    rows = computed(rows.repartition(tasks, *keys), growing=F.col("trend") == "mul", factor=F.col("seasonal") == "mul", suits=suits)
    centre, reach, state = [F.lit(0.5) for _ in WEIGHTS], REACH, ""
    for i in range(SEARCHES):
        alphas, betas, gammas = (_near(c, reach) for c in centre)
        grid = F.flatten(F.transform(alphas, _crossed(betas, gammas)))
        state = f"state_{i}"
        rows = computed(rows, **{f"grid_{i}": F.when(F.col("suits"), grid)})
        best = smoothed(F.col("y"), season, F.col("growing"), F.col("factor"), F.col(f"grid_{i}"))
        rows = computed(rows, **{state: F.when(F.col("suits"), best)})
        centre, reach = [F.col(f"{state}.weights.{w}") for w in WEIGHTS], reach / SHRINK
    return rows.select(*names, F.col(state).alias("state"))


def _crossed(betas: Column, gammas: Column):
    """Every beta and gamma behind an alpha."""
    return lambda a: F.flatten(F.transform(betas, lambda b: F.transform(gammas, lambda g: F.struct(
        a.alias("alpha"), b.alias("beta"), g.alias("gamma")))))


def holt_winters(series: DataFrame, season: int = SEASON_WEEKS) -> DataFrame:
    """Trend and season additive or multiplicative: the form with the least error on the last tenth of
    the train weeks, fitted again on all of them."""
    train = chronological_split(series.where("split = 'train'").drop("split"), F.floor(F.col("n") * 0.1))
    forms = F.explode(F.array(*[F.struct(F.lit(t).alias("trend"), F.lit(s).alias("seasonal")) for t, s in FORMS]))
    trial = as_arrays(train, "fit").withColumn("form", forms).select("series_key", "y", "test", "form.*")
    tried = smoothing_search(trial, season)
    ahead = extended(F.col("state"), season, F.col("trend"), F.col("seasonal"), F.size("test"))
    squares = total(F.zip_with("test", ahead, lambda p, v: (p["y"] - v) * (p["y"] - v)))
    error = F.when(F.col("state").isNotNull() & (F.size("test") > 0), F.sqrt(squares / F.size("test")))
    chosen = computed(tried, error=error).groupBy("series_key").agg(F.min_by(F.struct("trend", "seasonal"), "error").alias("form"))
    rows = as_arrays(series).join(chosen, "series_key", "left").select("series_key", "y", "n", "test", "form.trend", "form.seasonal")
    fits = smoothing_search(rows, season)
    n, k = F.col("n"), 3 + 2 + season
    quality = n * F.log(F.greatest(F.col("state.sse"), F.lit(1e-300)) / n)
    fitted = F.col("state").isNotNull() & (F.size("test") > 0)
    short = F.concat(F.lit(f"needs {2 * season} weeks, has "), F.col("n").cast("string"))
    note = F.when(F.col("state").isNotNull(), F.concat(F.lit("trend "), F.col("trend"), F.lit(", season "), F.col("seasonal"))).when(
        F.col("n") < 2 * season, short).when(F.col("trend").isNull(), F.lit(f"its first nine tenths need {2 * season} weeks")).otherwise("smoothing diverges")
    forecast = F.when(fitted, extended(F.col("state"), season, F.col("trend"), F.col("seasonal"), F.size("test")))
    rows = computed(fits, note=note, aic=F.when(fitted, quality + 2 * k), bic=F.when(fitted, quality + k * F.log(n)), forecast=forecast)
    return _by_week(rows, F.lit("HoltWinters"))


def smoothing_with(series: DataFrame, weights: tuple[float, float, float], trend: str = "add", seasonal: str = "add", season: int = SEASON_WEEKS) -> DataFrame:
    """Forecasts of a chosen form with chosen weights."""
    rows = as_arrays(series).where(F.col("n") >= 2 * season)
    kind = F.lit(trend), F.lit(seasonal)
    state = smoothed(F.col("y"), season, F.lit(trend == "mul"), F.lit(seasonal == "mul"), _one_weight(weights))
    rows = computed(rows, state=state)
    forecast = F.when(F.size("test") > 0, extended(F.col("state"), season, *kind, F.size("test")))
    nothing = F.lit(None).cast("double")
    rows = rows.select("*", forecast.alias("forecast"), nothing.alias("aic"), nothing.alias("bic"), F.lit(None).cast("string").alias("note"))
    return _by_week(rows, F.lit(f"smoothing_{trend}_{seasonal}"))


# --- Random forest on lags --------------------------------------------------------------------

SIZES, DEPTHS = (100, 200), (30, 10)
ROWS_PER_TASK = 10_000


def _dense(rows: DataFrame) -> DataFrame:
    """The rows in a fixed order, so many to a task: a forest draws its rows per task, and every task keeps
    sums for all nodes of a level, however few of its rows reach them."""
    tasks = max(1, -(-rows.count() // ROWS_PER_TASK))
    return rows.coalesce(tasks).sortWithinPartitions("series_key", "week").cache()


def forest_on_lags(series: DataFrame, lags: int = 4) -> DataFrame:
    """Forest over the last weeks' values, scaled per series; size and depth chosen on the last fifth.

    One forest serves all series. Test weeks use their actual lags, so this is a one-step forecast,
    unlike the others. Validation rows are scaled once. Node ids are kept beside the rows between levels;
    without them each level sends the trees grown so far to the tasks again, which took most of the time.
    """
    names = [f"lag_{i}" for i in range(1, lags + 1)]
    rows = lag_features(series, lags).withColumn("y", F.col("y").cast("double")).cache()
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    parts = chronological_split(train.drop("split"), F.ceil(F.col("n") * 0.2))
    fit_part, held = parts.where("split = 'fit'"), parts.where("split = 'validate'")

    def forest(trees: int, depth: int) -> Pipeline:
        return Pipeline(stages=[
            VectorAssembler(inputCols=names, outputCol="features"),
            RandomForestRegressor(labelCol="y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", seed=42, cacheNodeIds=True),
        ])

    scaled = _dense(minmax_scaled(fit_part, fit_part, names, ["series_key"]))
    scaled_held = minmax_scaled(fit_part, held, names, ["series_key"]).cache()
    miss = F.col("y") - F.col("prediction")
    errors = {
        (trees, depth): forest(trees, depth).fit(scaled).transform(scaled_held).agg(F.sqrt(F.avg(miss * miss))).first()[0]
        for trees in SIZES for depth in DEPTHS
    }
    trees, depth = min(errors, key=lambda p: float("inf") if errors[p] is None else errors[p])
    model = forest(trees, depth).fit(_dense(minmax_scaled(train, train, names, ["series_key"])))
    none = F.lit(None).cast("double")
    return model.transform(minmax_scaled(train, test, names, ["series_key"])).select(
        "series_key", F.lit("RandomForest").alias("model"), "week", "y", "prediction",
        none.alias("aic"), none.alias("bic"), F.lit(f"{trees} trees, depth {depth}").alias("note"),
    )


# --- Comparison -------------------------------------------------------------------------------


def all_forecasts(series: DataFrame, season: int = SEASON_WEEKS) -> DataFrame:
    models = [arima(series), sarima(series, season), holt_winters(series, season), forest_on_lags(series)]
    out = models[0]
    for other in models[1:]:
        out = out.unionByName(other)
    return out


def model_comparison(forecasts: DataFrame) -> DataFrame:
    """MAE, RMSE, MAPE, AIC and BIC per series and model; an unfit model keeps its row with nulls."""
    keys = ["series_key", "model"]
    fits = forecasts.groupBy(*keys).agg(F.max("aic").alias("aic"), F.max("bic").alias("bic"), F.max("note").alias("note"))
    return fits.join(forecast_metrics(forecasts.where("prediction is not null"), keys), keys, "left")


def plot_series(series: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Train, test and predicted values in one long table: (series_key, model, week, role, value)."""
    observed = series.select(
        "series_key", F.lit(None).cast("string").alias("model"), "week", F.col("split").alias("role"),
        F.col("y").cast("double").alias("value"),
    )
    predicted = forecasts.select("series_key", "model", "week", F.lit("prediction").alias("role"), F.col("prediction").alias("value"))
    return observed.unionByName(predicted)
