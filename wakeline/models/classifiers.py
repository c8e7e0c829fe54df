"""Vessel-type classifiers on the balanced sample: (id, actual, predicted) from train and test rows.

The sample is fixed in size (30000 rows), so training cost does not grow with the table it is
drawn from. Labels are numbered by StringIndexer; class weights go to the learners that take them.
"""

import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.constants import FEATURES
from wakeline.operators.scaling import standardised

SEED = 42
MAX_DEPTH = 30
FOREST_DEPTH = 20
TREES = 100
ITERATIONS = 1000
FOURIER_FEATURES = 128
SHIFTED_COPIES = 6
BOOST_ROUNDS = 50


def class_weights(train: DataFrame) -> DataFrame:
    """Balanced weight per class: rows / (classes x rows of the class)."""
    counts = train.groupBy("Type").agg(F.count("*").alias("n"))
    # One row per type code, so the unpartitioned windows stay tiny.
    return counts.select(
        "Type", (F.expr("sum(n) over ()") / (F.expr("count(*) over ()") * F.col("n"))).cast("double").alias("weight")
    )


def with_weights(train: DataFrame) -> DataFrame:
    return train.join(F.broadcast(class_weights(train)), "Type")


def fit(estimator, train: DataFrame, features: list[str] = FEATURES, weighted: bool = False) -> PipelineModel:
    """Pipeline of label index, vector assembly, the estimator and the label names."""
    rows = with_weights(train) if weighted else train
    indexer = StringIndexer(inputCol="Type", outputCol="label", stringOrderType="alphabetAsc").fit(rows)
    if weighted:
        estimator = estimator.copy({estimator.weightCol: "weight"})
    names = IndexToString(inputCol="prediction", outputCol="predicted_name", labels=indexer.labels)
    return Pipeline(stages=[
        indexer, VectorAssembler(inputCols=features, outputCol="features"), estimator, names
    ]).fit(rows)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(
        "id", F.col("Type").alias("actual"), F.col("predicted_name").cast("int").alias("predicted")
    )


def random_forest(train: DataFrame, test: DataFrame) -> DataFrame:
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=FOREST_DEPTH, featureSubsetStrategy="sqrt", seed=SEED, maxMemoryInMB=1024
    )
    return predict(fit(forest, train, weighted=True), test)


def decision_tree(train: DataFrame, test: DataFrame) -> DataFrame:
    tree = DecisionTreeClassifier(maxDepth=MAX_DEPTH, maxBins=256, impurity="gini", seed=SEED)
    return predict(fit(tree, train, weighted=True), test)


def logistic(train: DataFrame, test: DataFrame, c: float = 1.0) -> DataFrame:
    """Multinomial logistic regression with an L2 penalty of 1 / (C x total weight).

    Balanced weights add up to the number of rows.
    """
    regression = LogisticRegression(
        family="multinomial", maxIter=ITERATIONS, standardization=False, regParam=1.0 / (c * max(train.count(), 1))
    )
    return predict(fit(regression, standardised(train, train, FEATURES), weighted=True), standardised(train, test, FEATURES))


def fourier_features(df: DataFrame, columns: list[str], gamma: float, size: int = FOURIER_FEATURES) -> DataFrame:
    """Random features whose inner products approximate the RBF kernel exp(-gamma |x - y|^2)."""
    draw = random.Random(SEED)
    waves = []
    for _ in range(size):
        angle: Column = F.lit(draw.uniform(0.0, 2.0 * math.pi))
        for c in columns:
            angle = angle + F.lit(draw.gauss(0.0, math.sqrt(2.0 * gamma))) * F.col(c)
        waves.append(F.cos(angle) * math.sqrt(2.0 / size))
    return df.withColumn("waves", array_to_vector(F.array(*waves)))


def rbf_svm(train: DataFrame, test: DataFrame) -> DataFrame:
    """Balanced one-vs-rest linear machines over random Fourier features, in place of a kernel solver."""
    gamma = 1.0 / len(FEATURES)
    spread = [fourier_features(standardised(train, rows, FEATURES), FEATURES, gamma) for rows in (train, test)]
    machine = LinearSVC(maxIter=100, tol=1e-3, regParam=1e-4)
    model = fit(OneVsRest(classifier=machine, parallelism=4), spread[0], ["waves"], weighted=True)
    return predict(model, spread[1])


def gradient_boosting(train: DataFrame, test: DataFrame, rounds: int = 100) -> DataFrame:
    trees = GBTClassifier(maxIter=rounds, stepSize=0.1, maxDepth=3, seed=SEED)
    return predict(fit(OneVsRest(classifier=trees, parallelism=4), train), test)


def shifted_steps(df: DataFrame, ranges: dict[str, tuple[float, float]], copies: int = SHIFTED_COPIES) -> tuple[DataFrame, list[str]]:
    """Every feature as several step functions with random widths and offsets.

    A forest that chooses among them splits at random thresholds.
    """
    draw = random.Random(SEED)
    columns = {}
    for name, (low, high) in ranges.items():
        for i in range(copies):
            width = (high - low) / draw.uniform(8.0, 64.0) or 1.0
            start = low - draw.random() * width
            columns[f"{name}_{i}"] = F.floor((F.col(name) - F.lit(start)) / F.lit(width)).cast("double")
    return df.withColumns(columns), list(columns)


def extra_trees(train: DataFrame, test: DataFrame) -> DataFrame:
    """Forest without bootstrap over randomly offset steps of the features."""
    limits = train.agg(*[f(c).alias(f"{c}_{n}") for c in FEATURES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ranges = {c: (limits[f"{c}_lo"], limits[f"{c}_hi"]) for c in FEATURES}
    (stepped, columns), (stepped_test, _) = shifted_steps(train, ranges), shifted_steps(test, ranges)
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=FOREST_DEPTH, featureSubsetStrategy="sqrt", bootstrap=False, maxBins=128,
        seed=SEED, maxMemoryInMB=1024,
    )
    return predict(fit(forest, stepped, columns, weighted=True), stepped_test)


def perceptron(train: DataFrame, test: DataFrame) -> DataFrame:
    """One hidden layer of 100 units; MLlib's units are logistic and it trains by L-BFGS."""
    classes = train.select("Type").distinct().count()
    network = MultilayerPerceptronClassifier(
        layers=[len(FEATURES), 100, classes], maxIter=ITERATIONS, tol=1e-4, blockSize=1024, seed=SEED
    )
    return predict(fit(network, standardised(train, train, FEATURES)), standardised(train, test, FEATURES))


@dataclass(frozen=True)
class Stump:
    """A threshold on one feature with a class index on either side."""

    feature: str
    threshold: float
    left: float
    right: float

    def column(self) -> Column:
        return F.when(F.col(self.feature) <= self.threshold, self.left).otherwise(self.right)

    def sql(self) -> str:
        return f"if(`{self.feature}` <= cast('{self.threshold!r}' as double), {int(self.left)}, {int(self.right)})"


def boosted_stumps(train: DataFrame, rounds: int = BOOST_ROUNDS) -> tuple[list[str], list[tuple[Stump, float]]]:
    """Class names and weighted votes of multi-class boosting of one-split trees (SAMME).

    A stump is a threshold on one feature, so the running row weight is a plain expression over
    the features: every round reads the cached sample and no lineage builds up.
    """
    indexer = StringIndexer(inputCol="Type", outputCol="label", stringOrderType="alphabetAsc").fit(train)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = assembler.transform(indexer.transform(train)).select(*FEATURES, "features", "label").cache()
    classes = len(indexer.labels)
    learner = DecisionTreeClassifier(maxDepth=1, maxBins=256, weightCol="weight", seed=SEED)
    exponent: Column = F.lit(0.0)
    votes: list[tuple[Stump, float]] = []
    for _ in range(rounds):
        weighted = rows.withColumn("weight", F.exp(exponent))
        stump = _stump(learner.fit(weighted))
        miss = (stump.column() != F.col("label")).cast("double")
        error = weighted.agg(F.sum(F.col("weight") * miss) / F.sum("weight")).first()[0]
        if error >= 1.0 - 1.0 / classes:
            break
        strength = math.log(max(1.0 - error, 1e-12) / max(error, 1e-12)) + math.log(classes - 1.0)
        votes.append((stump, strength))
        exponent = exponent + miss * strength
        if error <= 0.0:
            break
    rows.unpersist()
    return indexer.labels, votes


def ada_boost(train: DataFrame, test: DataFrame, rounds: int = BOOST_ROUNDS) -> DataFrame:
    """The class with the largest sum of the stumps' weighted votes."""
    labels, votes = boosted_stumps(train, rounds)
    totals = [
        sum((F.when(stump.column() == float(k), strength).otherwise(0.0) for stump, strength in votes), F.lit(0.0))
        for k in range(len(labels))
    ]
    ballots = F.array(*totals)
    best = F.array_position(ballots, F.array_max(ballots)).cast("int")
    names = F.array(*[F.lit(int(n)) for n in labels])
    return test.select("id", F.col("Type").alias("actual"), F.get(names, best - 1).alias("predicted"))


def _stump(model) -> Stump:
    """The threshold of a fitted one-split tree; a tree without a split says the same on both sides."""
    root = model._call_java("rootNode")
    if model.numNodes == 1:
        return Stump(FEATURES[0], 0.0, float(root.prediction()), float(root.prediction()))
    split = root.split()
    left, right = (float(n.prediction()) for n in (root.leftChild(), root.rightChild()))
    return Stump(FEATURES[split.featureIndex()], float(split.threshold()), left, right)


CLASSIFIERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "random_forest": random_forest,
    "decision_tree": decision_tree,
    "logistic": logistic,
    "rbf_svm": rbf_svm,
    "gradient_boosting": gradient_boosting,
    "adaboost": ada_boost,
    "extra_trees": extra_trees,
    "mlp": perceptron,
}
