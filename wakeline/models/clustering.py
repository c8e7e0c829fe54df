"""Clustering input, projection to components, and the model-based algorithms of MLlib."""

from pyspark.ml.clustering import GaussianMixture, GaussianMixtureModel, KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.constants import CLUSTER_FEATURES, CLUSTER_SAMPLE_ROWS, FEATURES
from wakeline.functions.geo import with_utm
from wakeline.operators.sampling import fixed_sample
from wakeline.operators.scaling import standardised
from wakeline.session import checkpointed

CLUSTERS = 5
SEED = 42


def cluster_rows(df: DataFrame, sample_rows: int | None = CLUSTER_SAMPLE_ROWS) -> DataFrame:
    """Fixed-size sample without nulls and repeats, in metres; sample_rows=None keeps all rows."""
    rows = df.select("id", *FEATURES)
    rows = rows if sample_rows is None else fixed_sample(rows, sample_rows)
    distinct = rows.na.drop().groupBy(*FEATURES).agg(F.min("id").alias("id"))
    return with_utm(distinct).select("id", *CLUSTER_FEATURES)


def cluster_input(df: DataFrame, sample_rows: int | None = CLUSTER_SAMPLE_ROWS) -> DataFrame:
    """`cluster_rows` with standardised features; a sample is stored once, the whole table is read twice."""
    rows = cluster_rows(df, sample_rows)
    rows = rows if sample_rows is None else checkpointed(rows)
    return standardised(rows, rows, CLUSTER_FEATURES)


def assembled(df: DataFrame, features: list[str] = CLUSTER_FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features").transform(df)


def fit_kmeans(points: DataFrame, features: list[str] = CLUSTER_FEATURES, k: int = CLUSTERS) -> KMeansModel:
    return KMeans(k=k, seed=SEED, initMode="k-means||", predictionCol="cluster").fit(assembled(points, features))


def fit_mixture(points: DataFrame, features: list[str] = CLUSTER_FEATURES, k: int = CLUSTERS) -> GaussianMixtureModel:
    return GaussianMixture(k=k, seed=SEED, predictionCol="cluster").fit(assembled(points, features))


def label(model, points: DataFrame, features: list[str] = CLUSTER_FEATURES) -> DataFrame:
    return model.transform(assembled(points, features)).select(*points.columns, "cluster")


def fit_pca(points: DataFrame, features: list[str] = CLUSTER_FEATURES, k: int = 2) -> PCAModel:
    """Components of standardised rows; their mean is zero, so leaving them uncentred changes nothing."""
    return PCA(k=k, inputCol="features", outputCol="components").fit(assembled(points, features))


def _signs(model: PCAModel) -> list[float]:
    """A component's sign is free: make its largest loading positive."""
    columns = model.pc.toArray().T
    return [1.0 if c[abs(c).argmax()] >= 0 else -1.0 for c in columns]


def pca_components(model: PCAModel, points: DataFrame, features: list[str] = CLUSTER_FEATURES) -> DataFrame:
    rows = model.transform(assembled(points, features)).withColumn("_v", vector_to_array("components"))
    return rows.select("id", *[
        (F.col("_v")[i] * sign).alias(f"component_{i + 1}") for i, sign in enumerate(_signs(model))
    ])


def pca_loadings(model: PCAModel, points: DataFrame, features: list[str] = CLUSTER_FEATURES) -> DataFrame:
    """Component weights times the square root of the variance each component explains.

    MLlib reports explained variance as a share; d standardised columns have the total variance
    d * n / (n - 1).
    """
    weights = model.pc.toArray() * _signs(model)
    shares = model.explainedVariance.toArray()
    rows = [
        F.struct(
            F.lit(f).alias("feature"),
            *[
                (F.lit(float(weights[i, j])) * F.sqrt(F.lit(float(shares[j])) * F.col("total"))).alias(f"component_{j + 1}")
                for j in range(weights.shape[1])
            ],
        )
        for i, f in enumerate(features)
    ]
    n = F.count("*").cast("double")
    return points.agg((F.lit(float(len(features))) * n / (n - 1)).alias("total")).select(F.inline(F.array(*rows)))
