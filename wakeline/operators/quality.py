"""Cluster quality indices over rows of (id, cluster, features)."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeline.operators.pairwise import STEP, reduce_pairs, squared_distances, stacked
from wakeline.session import checkpointed

MAX_CLUSTERS = 4096


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("cluster").agg(F.count("*").alias("rows"))


def centroids(labelled: DataFrame, features: list[str]) -> DataFrame:
    return labelled.groupBy("cluster").agg(
        F.count("*").alias("n"), *[F.avg(f).alias(f"c_{f}") for f in features]
    )


def _spread_from_centre(features: list[str]):
    return sum(((F.col(f) - F.col(f"c_{f}")) * (F.col(f) - F.col(f"c_{f}")) for f in features), F.lit(0.0))


def calinski_harabasz(labelled: DataFrame, features: list[str]) -> DataFrame:
    """Ratio of between to within dispersion, from sums and sums of squares in one pass.

    Values should be standardised, as they are everywhere here, or the squares lose digits.
    """
    per_cluster = labelled.groupBy("cluster").agg(
        F.count("*").alias("n"),
        *[F.sum(f).alias(f"s_{f}") for f in features],
        sum((F.sum(F.col(f) * F.col(f)) for f in features), F.lit(0.0)).alias("squares"),
    )
    inner = sum((F.col(f"s_{f}") * F.col(f"s_{f}") / F.col("n") for f in features), F.lit(0.0))
    totals = per_cluster.agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("squares").alias("squares"),
        F.sum(inner).alias("inner"), *[F.sum(f"s_{f}").alias(f"s_{f}") for f in features],
    )
    overall = sum((F.col(f"s_{f}") * F.col(f"s_{f}") / F.col("n") for f in features), F.lit(0.0))
    between = (F.col("inner") - overall) / (F.col("k") - 1)
    within = (F.col("squares") - F.col("inner")) / (F.col("n") - F.col("k"))
    return totals.where("k > 1 and k < n").select(F.try_divide(between, within).alias("calinski_harabasz"))


def davies_bouldin(labelled: DataFrame, features: list[str]) -> DataFrame:
    """Mean over clusters of the worst (spread + spread) / distance ratio."""
    centres = centroids(labelled, features)
    # Centroids are aggregates and small in practice, yet unbounded; the optimizer sees their size.
    spread = labelled.join(centres, "cluster").groupBy("cluster", *[f"c_{f}" for f in features]).agg(
        F.avg(F.sqrt(_spread_from_centre(features))).alias("s")
    )
    columns = [f"c_{f}" for f in features]

    def worst(home: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if home.empty or other.empty:
            return pd.DataFrame({"cluster": [], "worst": []})
        distance = np.sqrt(squared_distances(home[columns].to_numpy(), other[columns].to_numpy()))
        total = home["s"].to_numpy()[:, None] + other["s"].to_numpy()[None, :]
        ratio = np.divide(total, distance, out=np.zeros_like(distance), where=distance > 0)
        ratio[home["cluster"].to_numpy()[:, None] == other["cluster"].to_numpy()[None, :]] = 0.0
        return pd.DataFrame({"cluster": home["cluster"], "worst": ratio.max(axis=1)})

    ratios = reduce_pairs(spread, spread, None, worst, "cluster int, worst double", row_id="cluster")
    per_cluster = ratios.groupBy("cluster").agg(F.max("worst").alias("worst"))
    return per_cluster.agg(F.avg("worst").alias("davies_bouldin"), F.count("*").alias("k")).where("k > 1").drop("k")


def silhouette_rows(labelled: DataFrame, features: list[str]) -> DataFrame:
    """Exact silhouette of every row: (id, cluster, silhouette); 0 in a cluster of one."""
    rows = labelled.select("id", F.col("cluster").cast("int").alias("cluster"), *features)

    def distance_sums(home: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        names, member = np.unique(other["cluster"].to_numpy(), return_inverse=True)
        inside = (member[:, None] == np.arange(len(names))[None, :]).astype("float64")
        here, there = home[features].to_numpy(), other[features].to_numpy()
        parts = []
        for at in range(0, len(home) if len(other) else 0, STEP):
            distance = squared_distances(here[at:at + STEP], there)
            parts.append(np.sqrt(distance, out=distance) @ inside)
        if not parts:
            return stacked([], ["id", "own", "cluster", "total"])
        return pd.DataFrame({
            "id": np.repeat(home["id"].to_numpy(), len(names)),
            "own": np.repeat(home["cluster"].to_numpy(), len(names)),
            "cluster": np.tile(names, len(home)),
            "total": np.concatenate(parts).ravel(),
        })

    sums = reduce_pairs(rows, rows, None, distance_sums, "id long, own int, cluster int, total double")
    sizes = cluster_sizes(rows)
    means = (
        sums.groupBy("id", "own", "cluster").agg(F.sum("total").alias("total"))
        .join(sizes, "cluster")
        .groupBy("id", "own")
        .agg(
            F.max(F.when(F.col("cluster") == F.col("own"), F.try_divide(F.col("total"), F.col("rows") - 1))).alias("a"),
            F.min(F.when(F.col("cluster") != F.col("own"), F.col("total") / F.col("rows"))).alias("b"),
        )
    )
    score = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return means.select("id", F.col("own").alias("cluster"), F.coalesce(score, F.lit(0.0)).alias("silhouette"))


def silhouette(labelled: DataFrame, features: list[str]) -> DataFrame:
    """Mean silhouette; no row when there are fewer than two clusters or only clusters of one."""
    counted = silhouette_rows(labelled, features).agg(
        F.avg("silhouette").alias("silhouette"), F.count_distinct("cluster").alias("k"), F.count("*").alias("n")
    )
    return counted.where("k > 1 and k < n").select("silhouette")


def silhouette_squared(labelled: DataFrame, features: list[str]) -> DataFrame:
    """Mean silhouette by squared distances, for whole tables: one pass for moments, one for the rows, no pairs.

    The mean squared distance of a row to a cluster follows from the cluster's count, sums and squares. These
    go to every task, so there may be at most ``MAX_CLUSTERS`` clusters. 0 in a cluster of one; no row when there
    are fewer than two clusters or only clusters of one. Rows with a null feature take no part.
    """
    rows = labelled.select(F.col("cluster").cast("int").alias("cluster"), *(F.col(f).cast("double").alias(f) for f in features)).na.drop(subset=features)
    # Distances do not change when the mean is taken off; squares and sums then lose no digits to it.
    centre = rows.agg(*(F.avg(f).alias(f) for f in features)).first()
    x = F.array(*(F.col(f) - F.lit(centre[f] or 0.0) for f in features))
    rows = rows.select("cluster", F.inline(F.array(F.struct(x.alias("x")))))
    place = [F.get("x", F.lit(i)) for i in range(len(features))]
    squares = sum((v * v for v in place), F.lit(0.0))
    moments = checkpointed(rows.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(squares).alias("q"), F.array(*(F.sum(v) for v in place)).alias("s")))
    k, n, least = moments.agg(F.count("*"), F.sum("n"), F.max("n")).first()
    if k > MAX_CLUSTERS:
        raise ValueError(f"{k} clusters; the moments of at most {MAX_CLUSTERS} go to every task")
    if k < 2 or least < 2:
        return rows.sparkSession.createDataFrame([], "silhouette_squared double")
    whole = F.broadcast(moments.agg(F.collect_list(F.struct("cluster", "n", "q", "s")).alias("all"), F.lit(1).alias("_one")))
    met = rows.withColumn("_one", F.lit(1)).join(whole, "_one")

    def apart(c: Column) -> Column:
        cross = sum((F.get("x", F.lit(i)) * F.get(c["s"], F.lit(i)) for i in range(len(features))), F.lit(0.0))
        return F.greatest(F.col("xx") + (c["q"] - 2 * cross) / c["n"], F.lit(0.0))

    met = met.withColumn("xx", squares)
    own = F.get(F.filter("all", lambda c: c["cluster"].eqNullSafe(F.col("cluster"))), F.lit(0))
    others = F.array_min(F.transform(F.filter("all", lambda c: ~c["cluster"].eqNullSafe(F.col("cluster"))), apart))
    scored = met.select(F.inline(F.array(F.struct(
        (apart(own) * own["n"] / F.greatest(own["n"] - 1, F.lit(1))).alias("a"), others.alias("b"), own["n"].alias("n")))))
    score = F.when(F.col("n") > 1, F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return scored.agg(F.avg(F.coalesce(score, F.lit(0.0))).alias("silhouette_squared"))


def quality(labelled: DataFrame, features: list[str]) -> DataFrame:
    """The three indices as (metric, value) rows; absent when they are undefined."""
    indices = [silhouette(labelled, features), calinski_harabasz(labelled, features), davies_bouldin(labelled, features)]
    long = [df.select(F.lit(df.columns[0]).alias("metric"), F.col(df.columns[0]).alias("value")) for df in indices]
    return long[0].unionByName(long[1]).unionByName(long[2])
