"""Mean shift with a flat kernel on the fixed-size sample it is defined for.

Every point is a seed and climbs on its own, so seeds are spread over tasks; each task holds the
sampled points (5000 rows by default) as its candidate block.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.constants import MEANSHIFT_SAMPLE_ROWS
from wakeline.operators.pairwise import reduce_pairs, squared_distances
from wakeline.operators.sampling import fixed_sample
from wakeline.session import checkpointed

QUANTILE = 0.3
MAX_ROUNDS = 300
SEEDS_PER_TASK = 512
MOST_ROWS = 20000


def bandwidth(points: DataFrame, features: list[str], n: int, quantile: float = QUANTILE) -> DataFrame:
    """Mean distance to the int(quantile * n)-th neighbour, a point being its own first: one row."""
    rows = points.select("id", *features)
    k = max(int(n * quantile), 1)

    def radius(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        d2 = squared_distances(here[features].to_numpy(), there[features].to_numpy())
        return pd.DataFrame({"radius": np.sqrt(np.partition(d2, k - 1, axis=1)[:, k - 1])})

    radii = reduce_pairs(rows, rows, None, radius, "radius double", home_rows=SEEDS_PER_TASK, candidate_rows=MOST_ROWS)
    return radii.agg(F.avg("radius").alias("bandwidth"))


def mean_shift(points: DataFrame, features: list[str], sample_rows: int = MEANSHIFT_SAMPLE_ROWS) -> DataFrame:
    """Sampled points with their cluster, numbered from the most crowded centre."""
    if sample_rows > MOST_ROWS:
        raise ValueError(f"mean shift holds its sample in every task: at most {MOST_ROWS} rows")
    sample = checkpointed(fixed_sample(points, sample_rows))
    n = sample.count()
    width = bandwidth(sample, features, n).first()["bandwidth"]
    rows = sample.select("id", *features)
    width2, stop2 = width * width, (1e-3 * width) ** 2
    columns = ", ".join(f"{f} double" for f in features)

    def climb(seeds: pd.DataFrame, all_points: pd.DataFrame) -> pd.DataFrame:
        b = all_points[features].to_numpy()
        centre = seeds[features].to_numpy().copy()
        inside = np.zeros(len(seeds), dtype="int64")
        active = np.arange(len(seeds))
        for _ in range(MAX_ROUNDS):
            if not len(active):
                break
            near = squared_distances(centre[active], b) <= width2
            count = near.sum(axis=1)
            moved = centre[active]
            held = count > 0
            moved[held] = (near[held].astype("float64") @ b) / count[held, None]
            step2 = ((moved - centre[active]) ** 2).sum(axis=1)
            centre[active], inside[active] = moved, count
            active = active[held & (step2 > stop2)]
        out = pd.DataFrame(centre, columns=features)
        return out.assign(inside=inside)

    def merge(centres: pd.DataFrame) -> pd.DataFrame:
        ranked = centres[centres["inside"] > 0].drop_duplicates(features).sort_values(
            ["inside", *features], ascending=False
        )
        at = ranked[features].to_numpy()
        alive = np.ones(len(at), dtype=bool)
        for i in range(len(at)):
            if alive[i]:
                alive[squared_distances(at[i:i + 1], at)[0] <= width2] = False
                alive[i] = True
        kept = ranked[alive][features].reset_index(drop=True)
        return kept.assign(cluster=np.arange(len(kept), dtype="int32"))

    peaks = reduce_pairs(rows, rows, None, climb, f"{columns}, inside long", home_rows=SEEDS_PER_TASK, candidate_rows=MOST_ROWS)
    # One centre per seed: bounded by the sample.
    centres = checkpointed(peaks.groupBy().applyInPandas(merge, f"{columns}, cluster int"))

    def nearest(here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        there = there.sort_values("cluster")
        d2 = squared_distances(here[features].to_numpy(), there[features].to_numpy())
        return pd.DataFrame({"id": here["id"], "cluster": there["cluster"].to_numpy()[d2.argmin(axis=1)]})

    labels = reduce_pairs(
        rows, centres.withColumn("id", F.col("cluster").cast("long")), None, nearest, "id long, cluster int",
        home_rows=SEEDS_PER_TASK, candidate_rows=MOST_ROWS,
    )
    return sample.join(labels, "id")
