"""The statistics run: clean reports in, one table per statistic out."""

from pyspark.sql import DataFrame

from wakeline.constants import HISTOGRAM_BINS
from wakeline.operators import counts, describe, histograms, layers, prepare


def statistics(reports: DataFrame, flags: DataFrame, stats: bool = True, corr: bool = True, plots: bool = True,
               maps: bool = True) -> dict[str, DataFrame]:
    """Lazy result tables by name; the four switches are independent of each other."""
    rows = prepare.prepared(reports, flags)
    out: dict[str, DataFrame] = {}
    if stats:
        out["describe_global"] = describe.describe(rows)
        out["describe_by_year"] = describe.describe(rows, ["year"])
    if corr:
        measured = [c for c in ("timestamp", "Latitude", "Longitude", "Distance", "Bearing") if c in rows.columns]
        out["correlation_by_year"] = describe.correlation(rows, ["year"], measured)
    if plots:
        out["vessel_types"] = counts.vessel_types_by_year(rows)
        out["messages_daily"] = counts.messages_daily(rows)
        out["messages_hourly"] = counts.messages_hourly(rows, "year")
        for column, bins in HISTOGRAM_BINS.items():
            out[f"hist_{column.lower()}"] = histograms.histogram(rows, ["year"], column, bins)
            out[f"density_{column.lower()}"] = histograms.density(rows, ["year"], column)
        out["hist_bearing_polar"] = histograms.polar_histogram(rows, ["year"], "Bearing")
    if maps:
        out["daily_map"] = layers.map_layer(layers.daily_map_points(rows), "date")
        out["bearing_map"] = layers.map_layer(layers.bearing_map_points(rows), "year")
    return out
