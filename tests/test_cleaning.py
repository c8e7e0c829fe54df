import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import position
from wakeline.constants import EXCLUDED_MMSI_ML, FOCUS_AREA
from wakeline.functions import geo, identity, time
from wakeline.operators import prepare
from wakeline.schema import numeric_columns, require_columns
from wakeline.sources.dimensions import local_flags


def inside(spark, points, ring=FOCUS_AREA):
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(points)], "i int, lon double, lat double")
    rows = df.select("i", geo.in_polygon("lon", "lat", ring).alias("v")).orderBy("i").collect()
    return [r.v for r in rows]


def test_area_boundary_and_missing_values_are_outside(spark):
    corners = FOCUS_AREA[:-1]
    assert inside(spark, corners) == [False] * len(corners)
    assert inside(spark, [(math.nan, 44.0), (14.0, math.nan), (None, 44.0), (14.0, None)]) == [False] * 4
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    assert inside(spark, [(2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0), (2.0, 2.0), (5.0, 2.0)], square) == [
        False, False, False, False, True, False]


def test_area_with_a_notch(spark):
    # Inside near the antenna's sea, west of the coast bend, and far away.
    assert inside(spark, [(13.6, 44.5), (13.0, 43.2), (0.0, 0.0)]) == [True, False, False]


def test_bounding_box_reaches_the_scan(spark, reports, tmp_path):
    path = str(tmp_path / "stored")
    reports.write.parquet(path)
    plan = prepare.in_focus_area(spark.read.parquet(path)).select("id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "GreaterThan(Longitude" in pushed


def test_identity_lists(spark):
    numbers = [0, 2470017, 992471123, 247000001, None]
    df = spark.createDataFrame([(n,) for n in numbers], "MMSI bigint")
    kept = [r.MMSI for r in prepare.real_vessels(df).collect()]
    assert kept == [247000001, None]
    assert [r.MMSI for r in prepare.real_vessels(df, EXCLUDED_MMSI_ML).collect()] == [0, 247000001, None]
    listed = spark.createDataFrame([(247000001,)], "MMSI bigint")
    assert sorted(str(r.MMSI) for r in prepare.without_listed(df, listed).collect()) == ["0", "2470017", "992471123", "None"]


def test_bearing_sector_is_closed(spark):
    rows = [{"id": i, "Bearing": b, "Latitude": 1.0, "Longitude": 1.0} for i, b in enumerate([180.0, 270.0, 179.999, 270.001, None])]
    rows.append({"id": 9, "Bearing": 200.0})
    assert sorted(r.id for r in prepare.in_bearing_sector(position(spark, rows)).collect()) == [0, 1]


def test_time_parts_ignore_the_session_zone(spark):
    df = spark.createDataFrame([(1609459199,), (1609632000,)], "timestamp bigint")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        rows = df.select(
            time.utc_year("timestamp").alias("y"), time.utc_hour("timestamp").alias("h"), time.iso_year("timestamp").alias("iy"),
            time.iso_week("timestamp").alias("iw"), time.weekday_name("timestamp").alias("d"),
            time.week_start("timestamp").cast("string").alias("w"), time.utc_datetime("timestamp").cast("string").alias("t"),
        ).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(r) for r in rows] == [
        (2020, 23, 2020, 53, "Thursday", "2020-12-28", "2020-12-31 23:59:59"),
        (2021, 0, 2020, 53, "Sunday", "2020-12-28", "2021-01-03 00:00:00"),
    ]


def test_flag_lookup_uses_the_written_digits(spark):
    df = spark.createDataFrame([(247000001,), (2470017,), (0,), (999999999,), (None,)], "MMSI bigint")
    rows = prepare.with_country(df, local_flags(spark)).collect()
    assert {r.MMSI: r.Country for r in rows} == {
        247000001: "Italy", 2470017: "Italy", 0: "Unknown", 999999999: "Unknown", None: "Unknown"}


def test_station_flag_with_and_without_padding(spark):
    df = spark.createDataFrame([(2470017,), (992471123,), (247000001,)], "MMSI bigint")
    rows = df.select(identity.is_station("MMSI").alias("a"), identity.is_station("MMSI", True).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(False, True), (True, True), (False, False)]


def test_column_checks(spark, reports):
    with pytest.raises(KeyError):
        require_columns(reports, "Nope")
    with pytest.raises(KeyError):
        prepare.in_focus_area(reports.drop("Latitude"))
    assert numeric_columns(prepare.with_time_parts(reports)).columns == [
        "timestamp", "Distance", "Bearing", "Type", "chunk", "Latitude", "Longitude"]


def test_projection_on_the_central_meridian_and_a_known_point(spark):
    df = spark.createDataFrame([(15.0, 45.0), (15.0, 0.0), (18.0, 0.0)], "Longitude double, Latitude double")
    rows = geo.with_utm(df).collect()
    assert rows[0].Easting == pytest.approx(500000.0, abs=1e-6)
    # Meridian arc from the equator to 45 degrees on WGS84, times the scale factor.
    assert rows[0].Northing == pytest.approx(4984944.378 * 0.9996, abs=0.01)
    assert rows[1].Northing == pytest.approx(0.0, abs=1e-6)
    assert rows[2].Easting == pytest.approx(833978.557, abs=0.01)


def test_distance_of_one_degree_of_latitude(spark):
    df = spark.range(1).select(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("d"))
    assert df.first().d == pytest.approx(6371 * math.pi / 180)


def test_audit(reports):
    rows = {r.stage: r.rows for r in prepare.filter_audit(reports).collect()}
    assert rows["all"] == reports.count() >= rows["focus_area"] >= rows["focus_area_and_identity"] > 0
