"""Position reports derived from the events table: the input of every registered query.

Event times are stretched by 48 to cover 2020-2023; identities and coordinates follow from the
event and user numbers by integer arithmetic, so that both engines agree bit for bit.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK_SECONDS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
DUCKDB_SECONDS = "cast(floor(epoch_us(ts) / 1000000e0) as bigint)"

COLUMNS = """
event_id as id,
cast(1577836800 + ({seconds} - 1704067200) * 48 + event_id % 48 as bigint) as timestamp,
cast(case when user_id = 0 then 0
          when user_id % 50 = 7 then 2470017
          when user_id % 50 = 11 then 992471000 + user_id
          else (case user_id % 6 when 0 then 247 when 1 then 238 when 2 then 278
                                 when 3 then 248 when 4 then 636 else 200 end) * 1000000 + user_id
     end as bigint) as MMSI,
42.5e0 + cast((user_id * 37) % 30 as double) / 10e0 + cast((event_id * 7919) % 1000 as double) / 4000e0 as Latitude,
12e0 + cast((user_id * 53) % 37 as double) / 10e0 + cast((event_id * 104729) % 1000 as double) / 4000e0 as Longitude,
value * 500e0 as Distance,
cast((event_id * 31 + user_id * 17) % 3600 as double) / 10e0 as Bearing,
cast(case user_id % 8 when 0 then 30 when 1 then 36 when 2 then 52 when 3 then 60
                      when 4 then 70 when 5 then 80 when 6 then 11 else 19 end as int) as Type,
cast(floor(event_id / 500e0) as bigint) as chunk
"""


def ais(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.selectExpr(*_split(COLUMNS.format(seconds=SPARK_SECONDS)))
    # Coordinates are computed once per row, as stored columns would be read once: without the
    # struct the optimizer copies their formulas into every edge test of the area filter.
    place = F.inline(F.array(F.struct("Latitude", "Longitude")))
    return rows.select(*[c for c in rows.columns if c not in ("Latitude", "Longitude")], place)


def _split(columns: str) -> list[str]:
    """Column expressions one by one; a comma at the end of a line separates them."""
    parts, current = [], ""
    for line in columns.strip().splitlines():
        current += " " + line.strip()
        if current.endswith(","):
            parts.append(current[:-1])
            current = ""
    return [*parts, current]


DUCKDB_VIEW = f"ais as (select {COLUMNS.format(seconds=DUCKDB_SECONDS)} from events)"
