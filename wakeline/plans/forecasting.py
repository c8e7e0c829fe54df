"""The forecasting run: weekly series, stationarity tests, models, comparison."""

from pyspark.sql import Column, DataFrame

from wakeline.models import forecast, stationarity
from wakeline.operators import series as ops


def weekly(reports: DataFrame, source: str | None = None, key: Column | None = None) -> DataFrame:
    """Weekly series with the train/test mark."""
    return ops.split_by_date(ops.weekly_vessels(reports, source, key))


def tests(weeks: DataFrame) -> dict[str, DataFrame]:
    """Both stationarity tests on the level and the first two differences."""
    long = ops.with_differences_as_series(weeks)
    return {"adf": stationarity.adf(long), "kpss": ops.kpss(long)}


def run(reports: DataFrame, source: str | None = None, key: Column | None = None) -> dict[str, DataFrame]:
    """Series, tests, forecasts and the comparison table. The series and forecasts are small and cached."""
    weeks = weekly(reports, source, key).cache()
    forecasts = forecast.all_forecasts(weeks).cache()
    return {
        "series": weeks,
        **tests(weeks),
        "forecasts": forecasts,
        "comparison": forecast.model_comparison(forecasts),
        "plot": forecast.plot_series(weeks, forecasts),
    }
