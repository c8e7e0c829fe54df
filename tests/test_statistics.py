import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import position
from wakeline.operators import counts, describe, histograms, layers, prepare, quantiles, tracks
from wakeline.sources.dimensions import local_flags

HOUR = 3600


def track_rows(spark, sizes, step=HOUR):
    rows, i = [], 0
    for mmsi, n in sizes.items():
        for k in range(n):
            rows.append({"id": i, "timestamp": 1600000000 + k * step, "MMSI": mmsi, "Type": 30})
            i += 1
    return position(spark, rows).withColumn("track_year", F.lit(2020))


@pytest.mark.parametrize("cells,rounds", [(4, 1), (4, 3), (16384, 1)])
def test_quantiles_equal_numpy(spark, cells, rounds):
    draw = np.random.default_rng(7)
    # A third of the rows share one value, and one outlier stretches the range.
    values = np.concatenate([np.full(100, 2.5), draw.normal(0, 1, 199), [1e6]])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 3.0)], "k string, value double")
    got = quantiles.exact_quantiles(quantiles.value_counts(df, ["k"]), ["k"], [0.0, 0.25, 0.5, 0.9, 1.0], cells=cells, rounds=rounds)
    found = {(r.k, r.probability): r.quantile for r in got.collect()}
    for p in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert found["a", p] == pytest.approx(np.quantile(values, p))
        assert found["b", p] == 3.0


@pytest.mark.parametrize("margins", [(0.01, 0.1, 1.0), (1e-9, 1.0), (1.0,)])
def test_sketched_quantiles_equal_numpy(spark, margins):
    draw = np.random.default_rng(3)
    values = {
        "ties": np.concatenate([np.full(4000, 2.5), draw.normal(0, 1, 7999), [1e9]]),
        "spread": np.exp(draw.normal(0, 6, 5001)), "flat": np.full(3000, 7.0), "few": np.array([3.0, 1.0, 2.0, 9.0]), "one": np.array([4.0]),
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("few", None), ("none", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(6)
    summary = df.groupBy("k").agg(
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), quantiles.sketch(F.col("value")).alias("sketch")).cache()
    asked = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = {(r.k, r.probability): r.quantile for r in quantiles.sketched_quantiles(df, summary, ["k"], asked, margins).collect()}
    assert found == {(k, p): pytest.approx(np.quantile(v, p), rel=1e-12) for k, v in values.items() for p in asked}


def test_only_values_around_the_ranks_are_kept(spark, monkeypatch):
    kept = []
    stored = quantiles.checkpointed
    monkeypatch.setattr(quantiles, "checkpointed", lambda df: kept.append(stored(df)) or kept[-1])
    df = spark.range(60_000).selectExpr("'x' as k", "cast(hash(id) as double) as value").repartition(4)
    summary = df.groupBy("k").agg(F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), quantiles.sketch(F.col("value")).alias("sketch")).cache()
    quantiles.sketched_quantiles(df, summary, ["k"], [0.25, 0.5, 0.75]).collect()
    # Three intervals of a fiftieth of the rows; everything else is one row before each interval.
    assert len(kept) == 2 and kept[0].count() < 60_000 * 3 * 0.03 and kept[0].where("value is null").count() <= 4


def test_density_equals_the_sum_over_all_values(spark):
    draw = np.random.default_rng(11)
    values = {2020: np.concatenate([draw.normal(0, 1, 900), [60.0, -55.0], np.full(90, 0.25)]), 2021: draw.uniform(0, 360, 700), 2022: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [(2020, None), (2023, 5.0), (2023, 5.0), (2024, float("nan"))]
    df = spark.createDataFrame(rows, "year int, x double").repartition(5)
    found = {}
    for r in histograms.density(df, ["year"], "x").collect():
        found.setdefault(r.year, []).append((r.point, r.location, r.density))
    assert set(found) == set(values)
    for year, x in values.items():
        h = x.std(ddof=1) * len(x) ** -0.2
        _, at, got = np.array(sorted(found[year])).T
        want = np.exp(-0.5 * ((at[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
        assert len(at) == 200 and np.abs(got - want).max() < 1e-10 * want.max()


def test_density_bins_follow_the_bandwidth_and_not_the_values(spark):
    df = spark.range(40_000).selectExpr("2020 as year", "cast(hash(id) as double) / 1e6 as x")
    stats = df.selectExpr("min(x) lo", "max(x) hi", "count(x) n", "stddev_samp(x) * pow(count(x), -0.2) bandwidth").first()
    rows = df.selectExpr("x", *(f"cast({v!r} as double) {k}" for k, v in stats.asDict().items()))
    bins = histograms._binned(rows, ["lo", "hi", "n", "bandwidth"])
    assert bins.count() <= (stats.hi - stats.lo) / stats.bandwidth / histograms.BIN + 1 < 400


def test_histogram_edges_and_constant_column(spark):
    df = spark.createDataFrame([(2020, v) for v in (0.0, 1.0, 4.99, 10.0, None)] + [(2021, 7.0)] * 3, "year int, x double")
    rows = {(r.year, r.bin): (r.rows, r.lower, r.upper) for r in histograms.histogram(df, ["year"], "x", 10).collect()}
    assert {k: v[0] for k, v in rows.items()} == {(2020, 0): 1, (2020, 1): 1, (2020, 4): 1, (2020, 9): 1, (2021, 5): 3}
    assert rows[2020, 9][1:] == (9.0, 10.0)


def test_density_integrates_to_one(spark):
    draw = np.random.default_rng(1)
    df = spark.createDataFrame([(2020, float(v)) for v in draw.normal(0, 1, 400)], "year int, x double")
    curve = sorted((r.location, r.density) for r in histograms.density(df, ["year"], "x").collect())
    x, y = np.array(curve).T
    assert len(x) == 200 and 0.95 < np.trapezoid(y, x) <= 1.0


def test_first_report_decides_the_type(spark):
    rows = position(spark, [
        {"id": 2, "MMSI": 1, "Type": 70}, {"id": 1, "MMSI": 1, "Type": 30}, {"id": 3, "MMSI": 2, "Type": 30},
    ]).withColumn("year", F.lit(2020))
    assert [tuple(r) for r in counts.vessel_types_by_year(rows).collect()] == [(2020, 30, 2)]


def test_describe_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", None), ("a", 3.0), ("b", 5.0)], "c string, x double")
    top = describe.describe_categorical(df, [], ["c"]).first()
    assert (top.top, top.freq, top["unique"], top["count"]) == ("a", 2, 2, 4)
    row = describe.describe_numeric(df, [], ["x"]).first()
    assert (row["count"], row["mean"], row["std"], row.p50) == (3, 3.0, 2.0, 3.0)


def test_correlation_is_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 9.0)], "a double, b double")
    got = {(r.column_a, r.column_b): r.correlation for r in describe.correlation(df, [], ["a", "b"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(1.0) and len(got) == 4


def test_track_sizes_and_split(spark):
    df = track_rows(spark, {1: 1, 2: 2, 3: 3, 4: 10, 5: 11})
    sizes = {r.MMSI: (r.rows, r.size_class) for r in tracks.track_sizes(df).collect()}
    assert sizes == {2: (2, "small"), 3: (3, "small"), 4: (10, "small"), 5: (11, "large")}
    assert tracks.tracks(df).count() == 26
    assert tracks.tracks_of_size(df, "small").count() == 15


def test_modal_type_takes_the_smaller_on_ties(spark):
    rows = position(spark, [{"id": i, "MMSI": 1, "Type": t} for i, t in enumerate([70, 30, 70, 30, None, None, None])])
    assert tracks.track_sizes(rows.withColumn("track_year", F.lit(2020))).first().modal_type == 30


def test_gaps_equal_numpy_across_days(spark):
    draw = np.random.default_rng(3)
    times = {m: np.sort(draw.integers(1600000000, 1600000000 + 5 * 86400, 60)) for m in (1, 2)}
    times[1][:5] = times[1][0]
    times[3] = np.array([1600000000] * 3)
    times[4] = np.array([1600000000, 1600000100])
    rows, i = [], 0
    for mmsi, ts in times.items():
        for t in ts:
            rows.append({"id": i, "timestamp": int(t), "MMSI": mmsi})
            i += 1
    df = position(spark, rows).withColumn("track_year", F.lit(2020))
    got = {r.MMSI: r for r in tracks.reporting_gaps(df).collect()}
    assert sorted(got) == [1, 2]
    for mmsi in (1, 2):
        gaps = np.diff(times[mmsi])
        assert got[mmsi].mean_s == pytest.approx(gaps.mean())
        assert got[mmsi].variance_s2 == pytest.approx(gaps.var(ddof=1))
        assert got[mmsi].rows == 60


def test_gap_census(spark):
    gaps = spark.createDataFrame([(300.0,), (100.0,), (7200.0,)], "mean_s double")
    got = {(r.unit, r.threshold): (r.less, r.equal, r.greater) for r in tracks.gap_threshold_census(gaps).collect()}
    assert len(got) == 35 and got["seconds", 300] == got["minutes", 5] == (1, 1, 1) and got["hours", 2] == (2, 1, 0)


def test_week_table_fills_zero_days(spark):
    df = track_rows(spark, {1: 2}, step=86400)
    rows = tracks.week_by_weekday(df).collect()
    # A Sunday and the Monday after it: two weeks of seven days.
    assert len(rows) == 14 and sum(r.messages for r in rows) == 2 and {r.month for r in rows} == {9}


def test_map_layer(spark, reports):
    rows = prepare.prepared(reports, local_flags(spark))
    points = layers.daily_map_points(rows)
    assert points.count() == rows.count()
    zones = spark.createDataFrame([("dock", [[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]])], "name string, ring array<array<double>>")
    shared = layers.map_layer(points, "date", zones).where("date is null")
    assert shared.count() == 3
    sector = layers.bearing_map_points(rows)
    assert 0 < sector.count() < rows.count() and "Bearing: " in sector.first().popup
