"""Headline queries, timed once warm: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES (comma
separated names) choose data, cores and queries. Results are written to a no-op sink, so every
row is computed and none passes the driver.
"""

import json
import os
import time

from verification.queries import QUERIES
from wakeline.session import local_session

HEADLINE = [
    "traffic_by_country", "focus_area", "identity_filter", "flag_country", "time_parts",
    "messages_daily", "vessel_types_by_year", "describe_by_year", "correlation_by_year", "hist_distance",
    "density_bearing", "tracks", "track_sizes", "reporting_gaps", "week_by_weekday",
    "weekly_vessels_per_source", "weekly_vessels_distinct", "kpss", "daily_map_points",
    "balanced_sample", "stratified_split", "knn_predictions", "utm_coordinates", "eps_neighbour_counts",
    "silhouette_exact", "cluster_kmeans", "forecast_holt_winters",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's compiler, the Arrow path and the Python workers before the clock runs.
    for name in ("traffic_by_country", "forecast_arima"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
