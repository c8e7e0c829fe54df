"""Trained models that can be kept: scaling, learner and class names together, saved and loaded as one.

Preparation that is not a stage of MLlib (population scaling, random waves and steps, the vote of boosted
stumps) is written as SQL over the rows, with the fitted numbers in the statement. MLlib saves such a stage
as text, so a model is one pipeline and scores rows that have no type yet. The nearest-neighbour
model is its scaled training rows, a table beside the scaling stage.
"""

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.constants import CLUSTER_FEATURES, FEATURES
from wakeline.models import classifiers as learners
from wakeline.models.neighbours import knn_predictions
from wakeline.operators.scaling import fit_standard

ROWS, STAGES, KIND = "rows", "stages", "kind"


def number(value: float) -> str:
    """A double literal of SQL."""
    return f"cast('{float(value)!r}' as double)"


def replacing(columns: dict[str, str]) -> SQLTransformer:
    """The rows with columns replaced or added by SQL expressions."""
    return SQLTransformer(statement=f"select * except ({', '.join(f'`{c}`' for c in columns)}), " + adding_list(columns) + " from __THIS__")


def adding(columns: dict[str, str]) -> SQLTransformer:
    return SQLTransformer(statement=f"select *, {adding_list(columns)} from __THIS__")


def adding_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} as `{name}`" for name, sql in columns.items())


def scaling_stage(train: DataFrame, columns: list[str]) -> SQLTransformer:
    """Means and population deviations of the training rows, one row, as a stage."""
    fitted = fit_standard(train, columns).first()
    return replacing({c: f"(`{c}` - {number(fitted[f'{c}__shift'])}) / {number(fitted[f'{c}__scale'])}" for c in columns})


def waves_stage(columns: list[str], gamma: float, size: int = learners.FOURIER_FEATURES) -> tuple[SQLTransformer, list[str]]:
    """The random waves of the RBF machine, one column each."""
    draw, waves = random.Random(learners.SEED), {}
    for i in range(size):
        angle = number(draw.uniform(0.0, 2.0 * math.pi))
        for c in columns:
            angle += f" + {number(draw.gauss(0.0, math.sqrt(2.0 * gamma)))} * `{c}`"
        waves[f"wave_{i}"] = f"cos({angle}) * {number(math.sqrt(2.0 / size))}"
    return adding(waves), list(waves)


def steps_stage(train: DataFrame, copies: int = learners.SHIFTED_COPIES) -> tuple[SQLTransformer, list[str]]:
    """The randomly offset steps of the extra trees."""
    limits = train.agg(*[f(c).alias(f"{c}_{n}") for c in FEATURES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    draw, steps = random.Random(learners.SEED), {}
    for c in FEATURES:
        low, high = limits[f"{c}_lo"], limits[f"{c}_hi"]
        for i in range(copies):
            width = (high - low) / draw.uniform(8.0, 64.0) or 1.0
            start = low - draw.random() * width
            steps[f"{c}_{i}"] = f"cast(floor((`{c}` - {number(start)}) / {number(width)}) as double)"
    return adding(steps), list(steps)


def _after(stages: list, model: PipelineModel) -> PipelineModel:
    """Preparation and learner in one; the class index of the training rows is not needed for scoring."""
    return PipelineModel([*stages, *(s for s in model.stages if not isinstance(s, StringIndexerModel))])


def _plain(estimator, train: DataFrame, weighted: bool = True) -> PipelineModel:
    return _after([], learners.fit(estimator, train, weighted=weighted))


def _scaled(estimator, train: DataFrame, weighted: bool = True) -> PipelineModel:
    scale = scaling_stage(train, FEATURES)
    return _after([scale], learners.fit(estimator, scale.transform(train), weighted=weighted))


def _forest(train: DataFrame) -> PipelineModel:
    return _plain(RandomForestClassifier(
        numTrees=learners.TREES, maxDepth=learners.FOREST_DEPTH, featureSubsetStrategy="sqrt", seed=learners.SEED, maxMemoryInMB=1024), train)


def _tree(train: DataFrame) -> PipelineModel:
    return _plain(DecisionTreeClassifier(maxDepth=learners.MAX_DEPTH, maxBins=256, impurity="gini", seed=learners.SEED), train)


def _logistic(train: DataFrame, c: float = 1.0) -> PipelineModel:
    return _scaled(LogisticRegression(
        family="multinomial", maxIter=learners.ITERATIONS, standardization=False, regParam=1.0 / (c * max(train.count(), 1))), train)


def _machine(train: DataFrame) -> PipelineModel:
    scale, (waves, names) = scaling_stage(train, FEATURES), waves_stage(FEATURES, 1.0 / len(FEATURES))
    machine = OneVsRest(classifier=LinearSVC(maxIter=100, tol=1e-3, regParam=1e-4), parallelism=4)
    return _after([scale, waves], learners.fit(machine, waves.transform(scale.transform(train)), names, weighted=True))


def _boosted_trees(train: DataFrame, rounds: int = 100) -> PipelineModel:
    return _plain(OneVsRest(classifier=GBTClassifier(maxIter=rounds, stepSize=0.1, maxDepth=3, seed=learners.SEED), parallelism=4), train, weighted=False)


def _extra_trees(train: DataFrame) -> PipelineModel:
    steps, names = steps_stage(train)
    forest = RandomForestClassifier(
        numTrees=learners.TREES, maxDepth=learners.FOREST_DEPTH, featureSubsetStrategy="sqrt", bootstrap=False, maxBins=128,
        seed=learners.SEED, maxMemoryInMB=1024)
    return _after([steps], learners.fit(forest, steps.transform(train), names, weighted=True))


def _perceptron(train: DataFrame) -> PipelineModel:
    layers = [len(FEATURES), 100, train.select("Type").distinct().count()]
    return _scaled(MultilayerPerceptronClassifier(layers=layers, maxIter=learners.ITERATIONS, tol=1e-4, blockSize=1024, seed=learners.SEED), train, weighted=False)


def _boosted_stumps(train: DataFrame, rounds: int = learners.BOOST_ROUNDS) -> PipelineModel:
    names, votes = learners.boosted_stumps(train, rounds)
    parts = [" + ".join([number(0.0), *(f"if({vote.sql()} = {k}, {number(strength)}, {number(0.0)})" for vote, strength in votes)]) for k in range(len(names))]
    ballots = adding({"ballots": f"array({', '.join(parts)})"})
    said = adding({"predicted_name": f"element_at(array({', '.join(repr(n) for n in names)}), cast(array_position(ballots, array_max(ballots)) as int))"})
    return PipelineModel([ballots, said])


LEARNERS: dict[str, Callable[[DataFrame], PipelineModel]] = {
    "random_forest": _forest, "decision_tree": _tree, "logistic": _logistic, "rbf_svm": _machine, "gradient_boosting": _boosted_trees,
    "adaboost": _boosted_stumps, "extra_trees": _extra_trees, "mlp": _perceptron,
}


@dataclass
class Trained:
    """A model and, for nearest neighbours, its training rows."""

    kind: str
    stages: PipelineModel
    rows: DataFrame | None = None

    def predict(self, reports: DataFrame) -> DataFrame:
        """(id, predicted) of reports with the features; a type, if they have one, is not read."""
        done = self.stages.transform(reports.select("id", *FEATURES))
        if self.rows is None:
            return done.select("id", F.col("predicted_name").cast("int").alias("predicted"))
        return knn_predictions(self.rows, done.withColumn("Type", F.lit(None).cast("int")), FEATURES).select("id", "predicted")

    def label(self, points: DataFrame) -> DataFrame:
        """Points in metres with the cluster of a stored clustering."""
        return points.join(self.stages.transform(points.select("id", *CLUSTER_FEATURES)).select("id", "cluster"), "id")

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/{STAGES}")
        spark = SparkSession.active()
        spark.createDataFrame([(self.kind,)], "kind string").coalesce(1).write.mode("overwrite").json(f"{path}/{KIND}")
        if self.rows is not None:
            self.rows.write.mode("overwrite").parquet(f"{path}/{ROWS}")


def train(kind: str, rows: DataFrame) -> Trained:
    """Fit one of the nine classifiers on rows with id, Type and the features."""
    if kind != "knn":
        return Trained(kind, LEARNERS[kind](rows))
    scale = scaling_stage(rows, FEATURES)
    return Trained(kind, PipelineModel([scale]), scale.transform(rows).select("id", "Type", *FEATURES))


def train_clusters(kind: str, points: DataFrame, k: int = 5) -> Trained:
    """Fit kmeans or mixture on points in metres (`clustering.cluster_rows`), scaling included."""
    makers = {"kmeans": KMeans(k=k, seed=learners.SEED, initMode="k-means||", predictionCol="cluster"), "mixture": GaussianMixture(k=k, seed=learners.SEED, predictionCol="cluster")}
    scale = scaling_stage(points, CLUSTER_FEATURES)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=CLUSTER_FEATURES, outputCol="features"), makers[kind]]).fit(scale.transform(points))
    return Trained(kind, PipelineModel([scale, *fitted.stages]))


def load(spark: SparkSession, path: str) -> Trained:
    kind = spark.read.schema("kind string").json(f"{path}/{KIND}").first().kind
    return Trained(kind, PipelineModel.load(f"{path}/{STAGES}"), spark.read.parquet(f"{path}/{ROWS}") if kind == "knn" else None)
