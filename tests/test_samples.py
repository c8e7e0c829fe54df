from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.operators import evaluation, sampling, scaling


def key(i):
    for _ in range(2):
        i = ((i % 1000003) * 48271 + 12345) % 2147483647
    return i


@pytest.fixture(scope="module")
def rows(spark):
    # One class holds most rows.
    return spark.range(5000).select(
        "id", F.when(F.col("id") % 10 < 7, 30).when(F.col("id") % 10 < 9, 70).otherwise(11).alias("Type"),
        F.col("id").cast("double").alias("x"),
    ).cache()


def smallest(ids, n):
    return set(sorted(ids, key=lambda i: (key(i), i))[:n])


def test_quota_takes_the_first_rows_of_each_class(rows):
    got = sampling.balanced_sample(rows, total=501).collect()
    assert Counter(r.Type for r in got) == {30: 250, 70: 250}
    assert {r.id for r in got if r.Type == 30} == smallest([i for i in range(5000) if i % 10 < 7], 250)


def test_quota_keeps_a_short_class_whole(rows):
    got = Counter(r.Type for r in sampling.balanced_sample(rows, total=4000).collect())
    assert got == {30: 2000, 70: 1000}


def test_fixed_sample(rows):
    assert {r.id for r in sampling.fixed_sample(rows, 777).collect()} == smallest(range(5000), 777)
    assert sampling.fixed_sample(rows, 6000).count() == 5000


def test_sample_of_equal_keys(spark):
    # Ids that are equal modulo the key's period share one key: the id decides.
    same = spark.range(300).select((F.col("id") * 1000003).alias("id"))
    assert {r.id for r in sampling.fixed_sample(same, 10).collect()} == {i * 1000003 for i in range(10)}


def test_split_is_a_stratified_partition(rows):
    got = sampling.stratified_split(rows).collect()
    assert len(got) == 5000
    counts = Counter((r.Type, r.split) for r in got)
    for kind in (11, 30, 70):
        total = counts[kind, "train"] + counts[kind, "test"]
        assert counts[kind, "train"] == int(total * 0.8)


def test_scaling_is_fitted_on_train(spark, rows):
    train, test = rows.where("id < 100"), rows.where("id >= 4990")
    x = np.arange(100)
    got = [r.x for r in scaling.standardised(train, test, ["x"]).orderBy("id").collect()]
    assert got == pytest.approx((np.arange(4990, 5000) - x.mean()) / x.std())
    got = [r.x for r in scaling.minmax_scaled(train, test, ["x"]).orderBy("id").collect()]
    assert got == pytest.approx(np.arange(4990, 5000) / 99)
    flat = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id bigint, x double")
    assert [r.x for r in scaling.standardised(flat, flat, ["x"]).collect()] == [0.0, 0.0]


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 3)], "actual int, predicted int")
    got = {r.label: r for r in evaluation.classification_report(df).collect()}
    assert (got["2"].precision, got["2"].recall, got["2"].f1, got["2"].support) == (0.0, 0.0, 0.0, 1)
    assert got["1"].precision == pytest.approx(2 / 3) and got["accuracy"].f1 == 0.75
    matrix = {(r.actual, r.predicted): r.rows for r in evaluation.confusion_matrix(df).collect()}
    assert len(matrix) == 9 and matrix[1, 1] == 2 and matrix[2, 1] == 1 and matrix[2, 2] == 0


def test_mape_leaves_zero_weeks_out(spark):
    rows = [("a", 0.0, 1.0), ("a", 2.0, 1.0), ("b", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "series_key string, y double, prediction double")
    got = {r.series_key: r for r in evaluation.forecast_metrics(df, ["series_key"]).collect()}
    assert (got["a"].mae, got["a"].rmse, got["a"].mape) == (1.0, 1.0, 50.0) and got["b"].mape is None


def test_shuffling_keeps_all_rows_in_an_order_of_its_own(spark):
    rows = spark.range(500).withColumn("Type", F.col("id") % 3)
    once, again = ([r.id for r in sampling.shuffled(df).collect()] for df in (rows, rows.repartition(7)))
    assert once == again != sorted(once) and sorted(once) == list(range(500))
    # No trace of the old order: halves of the result hold about half of either half of the rows.
    assert 80 < sum(i < 250 for i in once[:250]) < 170
