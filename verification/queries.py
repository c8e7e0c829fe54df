"""Registered queries: one per operator or tight family, over the derived position reports."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verification.ais_view import ais
from verification.shapes import shapes
from wakeline.constants import (
    ANTENNA_LAT, ANTENNA_LON, CLUSTER_FEATURES, EXCLUDED_MMSI_ML, FEATURES, HISTOGRAM_BINS, YEARS,
)
from wakeline.functions import geo, identity, time
from wakeline.models import classifiers, clustering, forecast, stationarity
from wakeline.models.dbscan import core_points
from wakeline.operators import (
    counts, describe, evaluation, histograms, layers, prepare, quality, sampling, scaling, series, tracks, zones,
)
from wakeline.plans import classification, clustering as cluster_plan, forecasting
from wakeline.schema import numeric_columns
from wakeline.session import checkpointed
from wakeline.sources import census, readers
from wakeline.sources.dimensions import local_flags, port_zones

Query = Callable[[SparkSession, str], DataFrame]
EPS, MIN_SAMPLES = 0.5, 5
SMOOTHING = (0.3, 0.05, 0.2)


def rounded(df: DataFrame, digits: int, **special: int) -> DataFrame:
    """Round floating columns so that both engines show the same digits."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    # Adding zero turns -0.0 into 0.0.
    return df.withColumns({c: F.round(c, special.get(c, digits)) + F.lit(0.0) for c in doubles})


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.prepared(ais(spark, sf), local_flags(spark))


def tracked(spark: SparkSession, sf: str) -> DataFrame:
    """Reports keyed by track year; here the year comes from the time, with files from their name."""
    return ais(spark, sf).withColumn("track_year", time.utc_year("timestamp"))


def weeks(spark: SparkSession, sf: str) -> DataFrame:
    return forecasting.weekly(classification.training_rows(ais(spark, sf)))


def sample_parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return classification.train_and_test(classification.training_rows(ais(spark, sf)))


# --- cleaning -----------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return counts.traffic_by_country(prepared(spark, sf))


def time_parts(spark: SparkSession, sf: str) -> DataFrame:
    return ais(spark, sf).select(
        "id", time.utc_datetime("timestamp").alias("datetime"), time.utc_date("timestamp").alias("date"),
        time.utc_year("timestamp").alias("year"), time.utc_month("timestamp").alias("month"),
        time.utc_hour("timestamp").alias("hour"), time.weekday_name("timestamp").alias("weekday"),
        time.iso_year("timestamp").alias("iso_year"), time.iso_week("timestamp").alias("iso_week"),
        time.week_start("timestamp").alias("week"),
    )


def flag_country(spark: SparkSession, sf: str) -> DataFrame:
    return prepare.with_country(ais(spark, sf), local_flags(spark)).select("id", "MMSI", "MID", "Country")


def station_flag(spark: SparkSession, sf: str) -> DataFrame:
    return ais(spark, sf).select(
        "id", identity.is_station("MMSI").alias("station"), identity.is_station("MMSI", padded=True).alias("station_padded")
    )


def listed_stations(spark: SparkSession, sf: str) -> DataFrame:
    """Exclusion by a table: the numbers seen on more than one class of vessel."""
    rows = ais(spark, sf)
    shared = rows.groupBy("MMSI").agg(F.min("Type").alias("a"), F.max("Type").alias("b")).where("a <> b")
    return prepare.without_listed(rows, shared).select("id", "MMSI")


def numeric_only(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(numeric_columns(prepare.with_time_parts(ais(spark, sf))), 9)


def popup_and_units(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ais(spark, sf).select(
        "id", prepare.popup(["MMSI", "Type"]).alias("popup"), prepare.distance_km("Distance").alias("distance_km"),
        F.radians("Bearing").alias("bearing_rad"),
    ), 9)


# --- tracks ---------------------------------------------------------------------------------------


def new_tracks_only(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracked(spark, sf)
    stored = tracks.tracks(rows.where("track_year < 2022"))
    return tracks.new_tracks(tracks.tracks(rows), stored).select("track_year", "MMSI", "id")


def saved_and_skipped(spark: SparkSession, sf: str) -> DataFrame:
    rows = tracked(spark, sf)
    return tracks.saved_and_skipped(tracks.tracks(rows), tracks.tracks(rows.where("track_year < 2022")))


def reporting_gaps(spark: SparkSession, sf: str) -> DataFrame:
    gaps = tracks.reporting_gaps(tracked(spark, sf))
    return rounded(gaps.select(
        "track_year", "MMSI", "rows", (F.col("mean_s") / 3600.0).alias("mean_h"),
        (F.col("variance_s2") / (3600.0 * 3600.0)).alias("variance_h2"),
    ), 6, mean_h=9)


def dataset_census(spark: SparkSession, sf: str) -> DataFrame:
    """Stage and file name per track and per source chunk, counted by year substring."""
    rows = tracked(spark, sf)
    size = tracks.track_sizes(rows).select(
        F.concat(F.lit("tracks_"), "size_class").alias("stage"),
        F.format_string("vessel_track_%d_%d.csv", "track_year", "MMSI").alias("name"),
    )
    chunks = rows.select(
        F.lit("csv").alias("stage"), F.format_string("ais_data_%d_p_%d.csv", "track_year", "chunk").alias("name")
    ).distinct()
    files = size.unionByName(chunks)
    return census.census(files, ["dumps", "csv", "tracks_small", "tracks_large"], YEARS)


# --- samples and models -----------------------------------------------------------------------------


def balanced_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = classification.training_rows(ais(spark, sf))
    return sampling.balanced_sample(rows).select("id", "Type")


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = classification.training_rows(ais(spark, sf))
    return classification.split_sample(rows).select("id", "Type", "split")


def fixed_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The mean-shift sample of 5000 rows."""
    return sampling.fixed_sample(classification.training_rows(ais(spark, sf)), 5000).select("id")


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classifiers.class_weights(sample_parts(spark, sf)[0]), 9)


def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stratified_split(spark, sf).groupBy("split", "Type").agg(F.count("*").alias("rows"))


def standardised(spark: SparkSession, sf: str) -> DataFrame:
    train, test = sample_parts(spark, sf)
    return rounded(scaling.standardised(train, test, FEATURES).select("id", *FEATURES), 9)


def minmax_scaled(spark: SparkSession, sf: str) -> DataFrame:
    train, test = sample_parts(spark, sf)
    return rounded(scaling.minmax_scaled(train, test, FEATURES).select("id", *FEATURES), 9)


def knn_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return classification.knn(*sample_parts(spark, sf))


def haversine(spark: SparkSession, sf: str) -> DataFrame:
    distance = geo.haversine_km("Latitude", "Longitude", F.lit(ANTENNA_LAT), F.lit(ANTENNA_LON))
    return rounded(ais(spark, sf).select("id", distance.alias("km")), 6)


def utm_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(geo.with_utm(ais(spark, sf)).select("id", "Easting", "Northing"), 3)


def cluster_points(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster_input(classification.training_rows(ais(spark, sf)))


def eps_neighbour_counts(spark: SparkSession, sf: str) -> DataFrame:
    return core_points(checkpointed(cluster_points(spark, sf)), CLUSTER_FEATURES, EPS, MIN_SAMPLES)


def typed_points(spark: SparkSession, sf: str) -> DataFrame:
    """Clustering input with the vessel type in place of a cluster."""
    types = ais(spark, sf).select("id", F.col("Type").alias("cluster"))
    return checkpointed(cluster_points(spark, sf).join(types, "id"))


def scored(name: str) -> Query:
    """Predictions of a classifier as a report of precision, recall, F1 and support."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        found = classification.predictions(ais(spark, sf), name)
        return rounded(evaluation.classification_report(found), 9)
    return query


def clustered(algorithm: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        points = checkpointed(cluster_points(spark, sf))
        return cluster_plan.labelled(points, algorithm).select("id", "cluster")
    return query


def pca_loadings(spark: SparkSession, sf: str) -> DataFrame:
    points = checkpointed(cluster_points(spark, sf))
    return clustering.pca_loadings(clustering.fit_pca(points), points)


def differenced(spark: SparkSession, sf: str) -> DataFrame:
    return series.with_differences_as_series(weeks(spark, sf))


def many_weeks(spark: SparkSession, sf: str) -> DataFrame:
    """The weekly series of all vessels and of every vessel type."""
    rows = classification.training_rows(ais(spark, sf))
    types = forecasting.weekly(rows, key=F.concat(F.lit("type "), F.col("Type").cast("string")))
    return forecasting.weekly(rows).unionByName(types)


def model_comparison(spark: SparkSession, sf: str) -> DataFrame:
    # Stored, as the comparison reads the forecasts twice.
    forecasts = checkpointed(forecast.all_forecasts(checkpointed(many_weeks(spark, sf))))
    return forecast.model_comparison(forecasts)


def by_country(spark: SparkSession, sf: str) -> DataFrame:
    """Forecast of one series per flag state."""
    return forecast.arima(forecasting.weekly(prepared(spark, sf), key=F.col("Country")))


def zone_of_report(spark: SparkSession, sf: str) -> DataFrame:
    """Reports in the ports and in the waters around them."""
    table = spark.createDataFrame([(n, [[list(p) for p in r] for r in rings]) for n, rings in shapes()], "name string, rings array<array<array<double>>>")
    return zones.in_zones(ais(spark, sf), table).select("id", "zone")


def hist(column: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = histograms.histogram(prepared(spark, sf), ["year"], column, HISTOGRAM_BINS[column])
        return rounded(rows, 9)
    return query


def dens(column: str) -> Query:
    return lambda s, d: rounded(histograms.density(prepared(s, d), ["year"], column), 9, location=6)


def describe_rows(keys: list[str]) -> Query:
    return lambda s, d: rounded(describe.describe(prepared(s, d), keys), 8, std=2, mean=4)


QUERIES: dict[str, Query] = {
    "traffic_by_country": flagship,
    "focus_area": lambda s, d: prepare.in_focus_area(ais(s, d)).select("id", "chunk"),
    "identity_filter": lambda s, d: prepare.real_vessels(ais(s, d)).select("id", "MMSI"),
    "identity_filter_ml": lambda s, d: prepare.real_vessels(ais(s, d), EXCLUDED_MMSI_ML).select("id", "MMSI"),
    "listed_stations": listed_stations,
    "zone_of_report": zone_of_report,
    "bearing_sector": lambda s, d: prepare.in_bearing_sector(ais(s, d)).select("id", "Bearing"),
    "usable_classes": lambda s, d: prepare.usable_classes(ais(s, d)).select("id", "Type"),
    "time_parts": time_parts,
    "flag_country": flag_country,
    "station_flag": station_flag,
    "numeric_columns": numeric_only,
    "popup_and_units": popup_and_units,
    "filter_audit": lambda s, d: prepare.filter_audit(ais(s, d)),
    "source_subset": lambda s, d: readers.first_sources(ais(s, d), "chunk", 10).select("chunk", "id"),
    "class_counts": lambda s, d: counts.class_quota(ais(s, d)),
    "vessel_types_by_year": lambda s, d: counts.vessel_types_by_year(prepared(s, d)),
    "messages_daily": lambda s, d: counts.messages_daily(prepared(s, d)),
    "messages_hourly": lambda s, d: counts.messages_hourly(prepared(s, d), "year"),
    "messages_hourly_all": lambda s, d: counts.messages_hourly(prepare.with_time_parts(ais(s, d))),
    "messages_weekday": lambda s, d: counts.messages_by_weekday(ais(s, d)),
    "distinct_dates": lambda s, d: counts.distinct_values(prepared(s, d), "date"),
    "describe_global": describe_rows([]),
    "describe_by_year": describe_rows(["year"]),
    "correlation_by_year": lambda s, d: rounded(describe.correlation(
        prepared(s, d), ["year"], ["timestamp", "Latitude", "Longitude", "Distance", "Bearing"]), 9),
    "hist_longitude": hist("Longitude"),
    "hist_latitude": hist("Latitude"),
    "hist_distance": hist("Distance"),
    "hist_bearing": hist("Bearing"),
    "hist_bearing_polar": lambda s, d: rounded(histograms.polar_histogram(prepared(s, d), ["year"], "Bearing"), 9),
    "density_bearing": dens("Bearing"),
    "density_latitude": dens("Latitude"),
    "tracks": lambda s, d: tracks.tracks(tracked(s, d)).select("track_year", "MMSI", "id", "timestamp"),
    "track_sizes": lambda s, d: tracks.track_sizes(tracked(s, d)),
    "small_tracks": lambda s, d: tracks.tracks_of_size(tracked(s, d), "small").select("track_year", "MMSI", "id"),
    "track_size_thresholds": lambda s, d: tracks.track_size_thresholds(tracked(s, d)),
    "reporting_gaps": reporting_gaps,
    "gap_threshold_census": lambda s, d: tracks.gap_threshold_census(tracks.reporting_gaps(tracked(s, d))),
    "track_box_stats": lambda s, d: rounded(tracks.box_stats(tracks.track_sizes(tracked(s, d))), 6),
    "week_by_weekday": lambda s, d: tracks.week_by_weekday(tracks.tracks(tracked(s, d))),
    "new_tracks_only": new_tracks_only,
    "saved_and_skipped": saved_and_skipped,
    "weekly_vessels_per_source": lambda s, d: series.weekly_vessels(classification.training_rows(ais(s, d)), "chunk"),
    "weekly_vessels_distinct": lambda s, d: series.weekly_vessels(classification.training_rows(ais(s, d))),
    "weekly_vessels_by_country": lambda s, d: series.weekly_vessels(prepared(s, d), key=F.col("Country")),
    "lag_features": lambda s, d: series.lag_features(weeks(s, d)),
    "differences": lambda s, d: series.differences(weeks(s, d)),
    "train_test_by_date": lambda s, d: weeks(s, d),
    "chronological_split": lambda s, d: series.chronological_split(
        weeks(s, d).drop("split"), F.floor(F.col("n") * 0.1)),
    "kpss": lambda s, d: rounded(series.kpss(differenced(s, d)), 6),
    "naive_forecast_metrics": lambda s, d: rounded(
        evaluation.forecast_metrics(series.lag_one_forecast(weeks(s, d))), 6),
    "daily_map_points": lambda s, d: layers.daily_map_points(prepared(s, d)),
    "bearing_map_points": lambda s, d: layers.bearing_map_points(prepared(s, d)),
    "daily_map_layer": lambda s, d: layers.map_layer(layers.daily_map_points(prepared(s, d)), "date", port_zones(s)),
    "dataset_census": dataset_census,
    "balanced_sample": balanced_sample,
    "fixed_sample": fixed_sample,
    "stratified_split": stratified_split,
    "split_counts": split_counts,
    "class_weights": class_weights,
    "standardised": standardised,
    "minmax_scaled": minmax_scaled,
    "knn_predictions": knn_predictions,
    "confusion_matrix": lambda s, d: evaluation.confusion_matrix(knn_predictions(s, d)),
    "classification_report": lambda s, d: rounded(evaluation.classification_report(knn_predictions(s, d)), 9),
    "accuracy": lambda s, d: rounded(evaluation.accuracy(knn_predictions(s, d)), 9),
    "haversine_to_antenna": haversine,
    "utm_coordinates": utm_coordinates,
    "cluster_input": lambda s, d: rounded(cluster_points(s, d), 6),
    "eps_neighbour_counts": eps_neighbour_counts,
    "cluster_sizes": lambda s, d: quality.cluster_sizes(typed_points(s, d)),
    "silhouette_exact": lambda s, d: rounded(quality.silhouette(typed_points(s, d), CLUSTER_FEATURES), 6),
    "silhouette_squared": lambda s, d: rounded(quality.silhouette_squared(typed_points(s, d), CLUSTER_FEATURES), 6),
    "calinski_harabasz": lambda s, d: rounded(quality.calinski_harabasz(typed_points(s, d), CLUSTER_FEATURES), 6),
    "davies_bouldin": lambda s, d: rounded(quality.davies_bouldin(typed_points(s, d), CLUSTER_FEATURES), 6),
    **{f"clf_{name}": scored(name) for name in classifiers.CLASSIFIERS},
    "cluster_kmeans": clustered("kmeans"),
    "cluster_gmm": clustered("mixture"),
    "cluster_dbscan": clustered("dbscan"),
    "cluster_meanshift": clustered("meanshift"),
    "pca_loadings": pca_loadings,
    "adf": lambda s, d: stationarity.adf(differenced(s, d)),
    "adf_without_lags": lambda s, d: rounded(stationarity.adf(differenced(s, d), most_lags=0).select(
        "series_key", "transform", "observations", "statistic"), 6),
    "smoothing_fixed": lambda s, d: rounded(forecast.smoothing_with(many_weeks(s, d), SMOOTHING).select(
        "series_key", "week", "y", "prediction"), 6),
    "forecast_arima": lambda s, d: forecast.arima(many_weeks(s, d)),
    "forecast_arima_by_country": by_country,
    "forecast_sarima": lambda s, d: forecast.sarima(many_weeks(s, d)),
    "forecast_holt_winters": lambda s, d: forecast.holt_winters(many_weeks(s, d)),
    "forecast_rf_lags": lambda s, d: forecast.forest_on_lags(weeks(s, d)),
    "model_comparison": model_comparison,
}
