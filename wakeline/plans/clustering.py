"""The clustering run: sample, project, scale, label, measure."""

from pyspark.sql import DataFrame

from wakeline.constants import CLUSTER_FEATURES
from wakeline.models import clustering as models
from wakeline.models.dbscan import dbscan
from wakeline.models.meanshift import mean_shift
from wakeline.operators.quality import cluster_sizes, quality
from wakeline.session import checkpointed


def labelled(points: DataFrame, algorithm: str) -> DataFrame:
    """Points with a cluster column by kmeans, mixture, dbscan or meanshift."""
    if algorithm == "kmeans":
        return models.label(models.fit_kmeans(points), points)
    if algorithm == "mixture":
        return models.label(models.fit_mixture(points), points)
    if algorithm == "dbscan":
        return dbscan(points, CLUSTER_FEATURES)
    if algorithm == "meanshift":
        return mean_shift(points, CLUSTER_FEATURES)
    raise ValueError(f"unknown algorithm {algorithm}")


def run(reports: DataFrame, algorithm: str) -> dict[str, DataFrame]:
    """Labelled rows, cluster sizes and the quality indices of one algorithm."""
    points = checkpointed(models.cluster_input(reports))
    rows = checkpointed(labelled(points, algorithm))
    return {"rows": rows, "sizes": cluster_sizes(rows), "metrics": quality(rows, CLUSTER_FEATURES)}
