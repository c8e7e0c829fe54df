"""Classifier and forecast scores from (actual, predicted) rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("actual", "predicted").agg(F.count("*").alias("rows"))


def confusion_matrix(predictions: DataFrame) -> DataFrame:
    """Counts for every pair of labels that occur, zeros included.

    The counts are at most (type codes) squared, so they fit one row of maps and arrays, from
    which the grid is read back.
    """
    cell = F.struct(F.struct("actual", "predicted"), "rows")
    table = confusion_counts(predictions).agg(
        F.map_from_entries(F.collect_list(cell)).alias("cells"),
        F.sort_array(F.array_union(F.collect_set("actual"), F.collect_set("predicted"))).alias("labels"),
    )
    grid = table.withColumn("actual", F.explode("labels")).withColumn("predicted", F.explode("labels"))
    found = F.try_element_at("cells", F.struct("actual", "predicted"))
    return grid.select("actual", "predicted", F.coalesce(found, F.lit(0)).alias("rows"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def classification_report(predictions: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label, then accuracy, macro and weighted averages.

    A ratio with nothing below the line is zero.
    """
    sides = confusion_counts(predictions).select(F.inline(F.array(
        F.struct(F.col("actual").alias("label"), F.col("rows").alias("support"), F.lit(0).cast("bigint").alias("said"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0).alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("rows").alias("said"),
                 F.lit(0).cast("bigint").alias("hits")),
    )))
    scores = sides.groupBy("label").agg(
        *[F.sum(c).alias(c) for c in ("support", "said", "hits")]
    ).select(
        F.col("label").cast("string").alias("label"), "support", "hits",
        _ratio(F.col("hits"), F.col("said")).alias("precision"),
        _ratio(F.col("hits"), F.col("support")).alias("recall"),
        _ratio(F.col("hits") * 2, F.col("said") + F.col("support")).alias("f1"),
    )
    metrics = ["precision", "recall", "f1"]
    total = F.sum("support")
    summary = scores.agg(
        total.alias("support"),
        (F.sum("hits") / total).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in metrics],
        *[(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in metrics],
    )
    names = {"accuracy": ["accuracy"] * 3, **{
        f"{kind} avg": [f"{kind}_{m}" for m in metrics] for kind in ("macro", "weighted")
    }}
    overall = summary.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("label"), "support", *[F.col(c).alias(m) for c, m in zip(columns, metrics)])
        for label, columns in names.items()
    ])))
    return scores.drop("hits").unionByName(overall)


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))


def forecast_metrics(forecasts: DataFrame, keys: list[str] = ["series_key", "model"]) -> DataFrame:
    """MAE, RMSE and MAPE of (y, prediction); weeks with y = 0 do not count in the MAPE."""
    miss = F.col("y") - F.col("prediction")
    relative = F.when(F.col("y") != 0, F.abs(miss / F.nullif(F.col("y"), F.lit(0))))
    return forecasts.groupBy(*keys).agg(
        F.avg(F.abs(miss)).alias("mae"),
        F.sqrt(F.avg(miss * miss)).alias("rmse"),
        (F.avg(relative) * 100).alias("mape"),
    )
