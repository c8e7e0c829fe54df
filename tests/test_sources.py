import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import position
from wakeline.functions import time
from wakeline.operators import tracks
from wakeline.sources import census, dimensions, readers, writers

DUMP = """-- header comment; with a semicolon
CREATE TABLE `ais` (`id` int(11), `name` varchar(20) DEFAULT ')');
INSERT INTO `ais` (`id`, `t`) VALUES (1,1577836800,247000001,43.5,13.5,1000.5,200.0,30),(2,'1577836801','247000002',NULL,13.5,NULL,'10.5',NULL);
INSERT INTO `ais` VALUES
(3,1577836802,247000003,43.1,13.1,5,6,'it\\'s, (x)'),
(4,1577836803,247000004.0,43.2,13.2,5,6,70);
"""


def test_dump(spark, tmp_path):
    (tmp_path / "ais_stat_data_2021.sql").write_text(DUMP)
    rows = {r.id: r for r in readers.read_dumps(spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    assert tuple(rows[1]) == (1, 1577836800, 247000001, 43.5, 13.5, 1000.5, 200.0, 30, 2021)
    assert (rows[2].MMSI, rows[2].Latitude, rows[2].Distance, rows[2].Bearing, rows[2].Type) == (247000002, None, None, 10.5, None)
    assert (rows[3].Bearing, rows[3].Type) == (6.0, None)
    assert (rows[4].MMSI, rows[4].Type) == (247000004, 70)


def test_csv_by_year_and_missing_files(spark, tmp_path):
    header = "id,timestamp,MMSI,Latitude,Longitude,Distance,Bearing,Type\n"
    (tmp_path / "ais_data_2020_p_1.csv").write_text(header + "1,10,247000001.0,1.5,2.5,3,4,30\n2,11,NULL,,NaN,3,4,\n")
    (tmp_path / "ais_data_2021_p_1.csv").write_text(header + "3,12,247000001,1.5,2.5,3,4,30\n")
    both = readers.read_csv(spark, str(tmp_path)).orderBy("id").collect()
    assert [r.id for r in both] == [1, 2, 3] and both[0].MMSI == 247000001
    assert (both[1].MMSI, both[1].Latitude, both[1].Longitude, both[1].Type) == (None, None, None, None)
    assert [r.source_file for r in readers.read_csv(spark, str(tmp_path), year=2021).collect()] == ["ais_data_2021_p_1.csv"]
    assert [os.path.basename(p) for p in readers.first_files(spark, str(tmp_path), 1)] == ["ais_data_2020_p_1.csv"]
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, str(tmp_path), year=2019)


def test_tracks_take_their_keys_from_the_name(spark, tmp_path):
    (tmp_path / "vessel_track_2021_247202000.csv").write_text(
        "id,timestamp,Latitude,Longitude,Distance,Bearing,Type\n1,10,1.5,2.5,3,4,30\n")
    row = readers.read_tracks(spark, str(tmp_path)).first()
    assert (row.track_year, row.MMSI, row.id) == (2021, 247202000, 1)


def test_chunks_are_bounded(spark, tmp_path):
    rows = position(spark, [{"id": i} for i in range(25)]).coalesce(1)
    writers.write_chunks(rows, str(tmp_path / "out"), rows=10)
    files = [f for f in os.listdir(tmp_path / "out") if f.endswith(".csv")]
    sizes = sorted(len((tmp_path / "out" / f).read_text().splitlines()) - 1 for f in files)
    assert sizes == [5, 10, 10]


def test_focus_area_set_per_source(spark, reports, tmp_path):
    path = str(tmp_path / "area")
    writers.write_focus_area(reports.withColumn("source_file", F.concat(F.lit("f"), "chunk")), path)
    stored = spark.read.parquet(path)
    assert 0 < stored.count() < reports.count()
    assert stored.select("source_file").distinct().count() == reports.select("chunk").distinct().count()


def test_track_store_skips_what_it_holds(spark, reports, tmp_path):
    path = str(tmp_path / "tracks")
    rows = reports.withColumn("track_year", time.utc_year("timestamp"))
    first = writers.append_tracks(rows.where("track_year < 2022"), path)
    second = writers.append_tracks(rows, path)
    assert first["skipped"] == 0 and second["skipped"] == first["saved"] > 0 and second["saved"] > 0
    third = writers.append_tracks(rows, path)
    assert third == {"saved": 0, "skipped": first["saved"] + second["saved"]}
    stored = spark.read.parquet(path)
    assert stored.count() == stored.select("id").distinct().count()
    assert writers.stored_track_keys(spark, path).count() == third["skipped"]


def test_track_table_is_read_without_an_exchange(spark, reports, tmp_path):
    rows = reports.withColumn("track_year", time.utc_year("timestamp"))
    writers.write_track_table(rows, "bucketed_tracks", str(tmp_path / "table"), 8)
    try:
        table = spark.table("bucketed_tracks")
        sizes = tracks.track_sizes(table)
        assert "Exchange" not in sizes._jdf.queryExecution().executedPlan().toString()
        want = tracks.track_sizes(tracks.tracks(rows))
        assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, want.collect()))
        keys = table.select("track_year", "MMSI").distinct()
        assert "Exchange" not in keys._jdf.queryExecution().executedPlan().toString()
        assert table.count() == tracks.tracks(rows).count()
    finally:
        spark.sql("drop table if exists bucketed_tracks")


def test_census_counts_by_substring(spark, tmp_path):
    (tmp_path / "tracks").mkdir()
    (tmp_path / "tracks" / "vessel_track_2021_247202000.csv").write_text("x")
    stages = {"tracks": str(tmp_path / "tracks"), "gone": str(tmp_path / "gone")}
    files = census.list_files(spark, stages)
    got = {(r.stage, r.year): r.files for r in census.census(files, list(stages)).collect()}
    assert (got["tracks", 2020], got["tracks", 2021], got["tracks", 2022], got["tracks", None]) == (1, 1, 0, 1)
    assert got["gone", 2020] == got["gone", None] == 0
    assert census.names_of_small_stages(files).first().name == "vessel_track_2021_247202000.csv"


def test_dimension_files(spark, tmp_path):
    (tmp_path / "mid.csv").write_text("code,country\n247,Italy\n")
    assert [tuple(r) for r in dimensions.read_flags(spark, str(tmp_path / "mid.csv")).collect()] == [("247", "Italy")]
    (tmp_path / "zones.json").write_text(
        '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"dock"},'
        '"geometry":{"type":"Polygon","coordinates":[[[1.0,2.0],[3.0,4.0],[1.0,2.0]]]}}]}')
    zone = dimensions.read_zones(spark, str(tmp_path / "zones.json")).first()
    assert zone.name == "dock" and zone.ring == [[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]]
