import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import position
from wakeline.functions import arrays
from wakeline.models import forecast, stationarity
from wakeline.operators import series as ops


def weekly(spark, values, key="ALL", test=10):
    start = dt.date(2020, 1, 6)
    rows = [
        (key, start + dt.timedelta(weeks=i), float(v), "test" if i >= len(values) - test else "train")
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "series_key string, week date, y double, split string")


def test_uniques_are_summed_over_sources(spark):
    rows = position(spark, [{"id": i, "MMSI": 5, "timestamp": 1600000000 + i} for i in range(4)])
    rows = rows.withColumn("file", F.when(F.col("id") < 2, "a").otherwise("b"))
    assert ops.weekly_vessels(rows, "file").first().y == 2
    assert ops.weekly_vessels(rows).first().y == 1


def test_lags_and_differences(spark):
    weeks = weekly(spark, [1, 4, 9, 16, 25, 36])
    assert [(r.lag_1, r.lag_4) for r in ops.lag_features(weeks).orderBy("week").collect()] == [(16.0, 1.0), (25.0, 4.0)]
    got = ops.differences(weeks).orderBy("week").collect()
    assert [r.diff_1 for r in got] == [None, 3.0, 5.0, 7.0, 9.0, 11.0] and [r.diff_2 for r in got][2:] == [2.0] * 4


def test_adf_on_a_trending_and_a_stationary_series(spark):
    draw = np.random.default_rng(0)
    noise = weekly(spark, draw.normal(0, 1, 200))
    walk = weekly(spark, np.cumsum(draw.normal(0, 1, 200)), key="walk")
    long = noise.unionByName(walk).select("series_key", F.lit("level").alias("transform"), "week", F.col("y").alias("value"))
    got = {r.series_key: r for r in stationarity.adf(long).collect()}
    assert got["ALL"].p_value < 0.01 and got["walk"].p_value > 0.05
    assert got["ALL"].crit_5 == pytest.approx(-2.876, abs=0.01)
    kpss = {r.series_key: r for r in ops.kpss(long).collect()}
    assert kpss["ALL"].p_value > 0.05 and kpss["walk"].p_value < 0.05


def test_p_value_at_the_critical_values(spark):
    rows = spark.createDataFrame([(v,) for v in (-2.86154, -3.43035, -30.0, 3.0)], "s double")
    at = {r.s: r.p for r in rows.select("s", stationarity.p_value(F.col("s")).alias("p")).collect()}
    assert at[-2.86154] == pytest.approx(0.05, abs=0.002)
    assert at[-3.43035] == pytest.approx(0.01, abs=0.001)
    assert at[-30.0] == 0.0 and at[3.0] == 1.0


def test_algebra_on_arrays_equals_numpy(spark):
    draw = np.random.default_rng(4)
    x, y = draw.normal(3, 1, (5, 40)), draw.normal(0, 1, 40)
    row = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<array<double>>, y array<double>")
    got = row.select(arrays.regression(F.col("x"), F.col("y")).alias("b"), arrays.recursive(F.col("y"), F.lit(0.5), 3).alias("r"),
                     arrays.moving(F.col("y"), F.lit(0.5), 3).alias("m"), arrays.differenced(F.col("y"), 2).alias("d")).first()
    assert got.b == pytest.approx(np.linalg.lstsq(x.T, y, rcond=None)[0], rel=1e-9)
    back = np.array(got.r)
    assert back + 0.5 * np.concatenate((np.zeros(3), back[:-3])) == pytest.approx(y)
    assert got.m == pytest.approx(y - 0.5 * np.concatenate((np.zeros(3), y[:-3]))) and got.d == pytest.approx(y[2:] - y[:-2])
    z = [-9.0, -3.0, -1.5, 0.0, 0.5, 4.0]
    probabilities = spark.createDataFrame([(v,) for v in z], "z double").select("z", arrays.normal_probability(F.col("z")).alias("p")).collect()
    assert [r.p for r in probabilities] == pytest.approx([0.5 * math.erfc(-v / math.sqrt(2)) for v in z], abs=1e-12)
    alike = spark.createDataFrame([([[1.0, 1.0], [1.0, 1.0]], [1.0, 2.0])], "x array<array<double>>, y array<double>")
    assert None in alike.select(arrays.regression(F.col("x"), F.col("y")).alias("b")).first().b


def adf_by_force(v, most):
    """(observations, lags, statistic) by numpy."""
    step = np.diff(v)

    def fit(lags, start):
        rows = np.arange(start, len(step))
        x = np.column_stack([v[rows], np.ones(len(rows)), *(step[rows - i] for i in range(1, lags + 1))])
        beta = np.linalg.lstsq(x, step[rows], rcond=None)[0]
        sse = ((step[rows] - x @ beta) ** 2).sum()
        return len(rows), sse, x, beta

    lags = min(range(most + 1), key=lambda k: (lambda n, sse, x, _: n * np.log(sse / n) + 2 * x.shape[1])(*fit(k, most)))
    n, sse, x, beta = fit(lags, lags)
    return n, lags, beta[0] / np.sqrt(sse / (n - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])


def test_adf_equals_numpy_on_many_series(spark):
    draw = np.random.default_rng(12)
    series = {}
    for i, n in enumerate((10, 11, 30, 80, 206)):
        series[f"walk{n}"], series[f"noise{n}"] = 1000 + np.cumsum(draw.normal(0, 1, n)), draw.normal(1e4, 3, n)
    start = dt.date(2020, 1, 6)
    rows = [(k, "level", start + dt.timedelta(weeks=i), float(x)) for k, v in series.items() for i, x in enumerate(v)]
    rows += [("flat", "level", start + dt.timedelta(weeks=i), 3.0) for i in range(40)] + [("few", "level", start, 1.0)]
    long = spark.createDataFrame(rows, "series_key string, transform string, week date, value double")
    got = {r.series_key: r for r in stationarity.adf(long).collect()}
    assert set(got) == set(series)
    for k, v in series.items():
        most = min(math.ceil(12 * (len(v) / 100) ** 0.25), len(v) // 2 - 2)
        n, lags, statistic = adf_by_force(v, most)
        assert (got[k].observations, got[k].lags) == (n, lags) and got[k].statistic == pytest.approx(statistic, rel=1e-7)


def test_arima_recovers_its_processes(spark):
    draw = np.random.default_rng(3)
    known = {"one": (0.6, 0.3), "two": (-0.5, 0.7), "three": (0.8, -0.2)}
    weeks, shocks = None, {}
    for key, (a, b) in known.items():
        e, w = draw.normal(0, 1, 600), np.zeros(600)
        w[0] = e[0]
        for t in range(1, 600):
            w[t] = a * w[t - 1] + e[t] + b * e[t - 1]
        shocks[key] = (e @ e)
        one = weekly(spark, np.cumsum(np.append(w, [0.0] * 3)), key=key, test=3)
        weeks = one if weeks is None else weeks.unionByName(one)
    fits = {r.series_key: r for r in forecast.arima_fits(weeks).collect()}
    for key, (a, b) in known.items():
        assert fits[key].p == pytest.approx([a, b], abs=0.12)
        # No worse than with the true coefficients, but for the first difference that is left out.
        assert np.dot(fits[key].e, fits[key].e) <= shocks[key] * 1.01
    got = forecast.arima(weeks).groupBy("series_key").agg(F.count("prediction").alias("n"), F.first("aic").alias("aic"), F.first("bic").alias("bic")).collect()
    assert len(got) == 3 and all(r.n == 3 and r.bic > r.aic for r in got)


def test_seasonal_arima_follows_its_season(spark):
    draw = np.random.default_rng(6)
    season, n = 6, 300
    e, w = draw.normal(0, 1, n), np.zeros(n)
    for t in range(n):
        past = lambda x, k: x[t - k] if t >= k else 0.0
        w[t] = 0.5 * past(w, 1) + 0.4 * past(w, season) - 0.2 * past(w, season + 1) + e[t]
    y = np.concatenate((np.zeros(season + 1), np.zeros(n)))
    for t in range(n):
        i = t + season + 1
        y[i] = y[i - 1] + y[i - season] - y[i - season - 1] + w[t]
    fit = forecast.arima_fits(weekly(spark, y, test=5), season).first()
    assert fit.p[:2] == pytest.approx([0.5, 0.4], abs=0.25) and np.dot(fit.e, fit.e) <= (e[:-5] @ e[:-5]) * 1.02


def test_forecasts_and_reasons(spark):
    t = np.arange(170)
    wave = 50 + 0.1 * t + 10 * np.sin(2 * np.pi * t / 52) + np.random.default_rng(8).normal(0, 0.5, 170)
    weeks = weekly(spark, wave).unionByName(weekly(spark, [7.0] * 40, key="flat")).unionByName(
        weekly(spark, wave[:62], key="short")).cache()
    everything = forecast.arima(weeks).unionByName(forecast.sarima(weeks)).unionByName(forecast.holt_winters(weeks)).cache()
    got = {(r.series_key, r.model.split("_")[0]): r for r in forecast.model_comparison(everything).collect()}
    assert len(got) == 9
    assert got["ALL", "HoltWinters"].mape < 5 and got["ALL", "SARIMAX"].mape < 5
    assert got["flat", "ARIMA"].mae is None and "constant" in got["flat", "ARIMA"].note
    assert got["short", "SARIMAX"].mae is None and "needs" in got["short", "SARIMAX"].note
    assert got["short", "HoltWinters"].rmse is None and "needs" in got["short", "HoltWinters"].note
    roles = {r.role: r.n for r in forecast.plot_series(weeks, everything).groupBy("role").agg(F.count("*").alias("n")).collect()}
    assert roles["prediction"] == 90 and roles["test"] == 30


def test_smoothing_with_full_weight_repeats_the_last_value(spark):
    got = forecast.smoothing_with(weekly(spark, [3.0, 5.0, 4.0, 6.0, 8.0, 7.0, 1.0], test=1), (1.0, 0.0, 0.0), season=1).first()
    assert got.prediction == pytest.approx(7.0 + 2.0)  # the slope stays that of the first two weeks


def smoothed_by_force(y, m, trend, seasonal, weights, steps):
    alpha, beta, gamma = weights
    level, second = np.mean(y[:m]), np.mean(y[m:2 * m])
    slope = (second / level) ** (1 / m) if trend == "mul" else (second - level) / m
    season = [v / level if seasonal == "mul" else v - level for v in y[:m]]
    for t, v in enumerate(y):
        s, base = season[t % m], level * slope if trend == "mul" else level + slope
        new = alpha * (v / s if seasonal == "mul" else v - s) + (1 - alpha) * base
        slope = beta * (new / level if trend == "mul" else new - level) + (1 - beta) * slope
        season[t % m] = gamma * (v / base if seasonal == "mul" else v - base) + (1 - gamma) * s
        level = new
    out = []
    for h in range(1, steps + 1):
        base, s = level * slope**h if trend == "mul" else level + slope * h, season[(len(y) + h - 1) % m]
        out.append(base * s if seasonal == "mul" else base + s)
    return out


@pytest.mark.parametrize("trend,seasonal", forecast.FORMS)
def test_smoothing_equals_a_plain_loop(spark, trend, seasonal):
    y = 20 + np.random.default_rng(2).uniform(0, 5, 47) + 3 * np.sin(np.arange(47))
    weights = (0.3, 0.1, 0.25)
    got = forecast.smoothing_with(weekly(spark, y, test=9), weights, trend, seasonal, 7).orderBy("week").collect()
    assert [r.prediction for r in got] == pytest.approx(smoothed_by_force(y[:-9], 7, trend, seasonal, weights, 9), rel=1e-9)


def test_the_search_ends_near_the_least_error(spark):
    y = 30 + np.cumsum(np.random.default_rng(9).normal(0, 1, 60))
    rows = spark.createDataFrame([("a", "add", "add", y.tolist()), ("b", "mul", "add", (-y).tolist()), ("c", "add", "add", [1.0])],
                                 "series_key string, trend string, seasonal string, y array<double>")
    found = {r.series_key: r for r in forecast.smoothing_search(rows, 4).collect()}
    assert found["b"].state is None and found["c"].state is None
    least = found["a"].state.sse
    r = np.random.default_rng(1)
    tried = spark.createDataFrame([tuple(map(float, r.uniform(0.01, 0.99, 3))) for _ in range(300)], "alpha double, beta double, gamma double")
    state = forecast.smoothed(F.lit(y.tolist()), 4, F.lit(False), F.lit(False), F.array(F.struct("alpha", "beta", "gamma")))
    alone = tried.select(state["sse"]).collect()
    together = tried.agg(F.collect_list(F.struct("alpha", "beta", "gamma")).alias("w"))
    best = together.select(forecast.smoothed(F.lit(y.tolist()), 4, F.lit(False), F.lit(False), F.col("w"))["sse"]).first()[0]
    assert best == pytest.approx(min(r[0] for r in alone)) and least <= best * 1.01


def test_many_series_are_fitted_in_many_tasks(spark):
    weeks = weekly(spark, np.arange(30) ** 1.5, key="k0")
    for i in range(1, 12):
        weeks = weeks.unionByName(weekly(spark, np.arange(30) ** 1.5 + i, key=f"k{i}"))
    plan = forecast.arima(weeks)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("FlatMapGroups", "Python", "Pandas", "Arrow"))


def test_unit_seasonal_naive_split(spark):
    marked = ops.chronological_split(weekly(spark, range(25)).drop("split"), F.floor(F.col("n") * 0.1))
    assert marked.where("split = 'validate'").count() == 2


def test_forest_does_not_depend_on_the_number_of_partitions(spark, monkeypatch):
    monkeypatch.setattr(forecast, "SIZES", (10,))
    monkeypatch.setattr(forecast, "DEPTHS", (4,))
    values = [50.0 + 9 * math.sin(t / 3) + t % 7 for t in range(80)]
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 7):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            weeks = weekly(spark, values, key="a").unionByName(weekly(spark, values[:60], key="b")).unionByName(weekly(spark, values[::-1], key="c"))
            found.append({(r.series_key, r.week): r.prediction for r in forecast.forest_on_lags(weeks).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found[0]) == 30 and found[0] == found[1]
