import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.check import TABLES, table
from verification.ais_view import ais
from wakeline.plans import analysis
from wakeline.sources.dimensions import local_flags
from wakeline.sources.writers import write_results

CHECKED = [
    "traffic_by_country", "time_parts", "flag_country", "describe_by_year", "hist_longitude", "reporting_gaps",
    "gap_threshold_census", "week_by_weekday", "kpss", "bearing_map_points", "stratified_split", "dataset_census",
    "weekly_vessels_per_source", "cluster_input",
]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return connection


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = db.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([c[0] for c in cursor.description], cursor.fetchall())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_analysis_run_is_stored(spark, tmp_path):
    rows = ais(spark, SMALL).drop("chunk")
    tables = analysis.statistics(rows, local_flags(spark), stats=False, maps=False)
    assert "correlation_by_year" in tables and "describe_global" not in tables and "daily_map" not in tables
    some = {k: tables[k] for k in ("correlation_by_year", "messages_hourly")}
    write_results(some, str(tmp_path))
    stored = spark.read.parquet(str(tmp_path / "messages_hourly"))
    assert stored.count() == tables["messages_hourly"].count() and "year" in stored.columns
