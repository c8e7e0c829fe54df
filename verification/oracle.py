"""SQL for DuckDB that states what each registered query must return, written independently of the library."""

from verification.ais_view import DUCKDB_VIEW
from verification.shapes import shapes
from wakeline.constants import (
    ANTENNA_LAT, ANTENNA_LON, EXCLUDED_MMSI, EXCLUDED_MMSI_ML, EXCLUDED_PREFIXES, FEATURES, FOCUS_AREA,
    GAP_THRESHOLDS, HISTOGRAM_BINS, LOCAL_FLAGS, PORT_ZONES, TRACK_SIZE_THRESHOLDS, WEEKDAYS,
)
from wakeline.functions.geo import SCALE, krueger_series


def num(v: float) -> str:
    """Double literal."""
    return f"cast({v!r} as double)"


def texts(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def inside(lon: str, lat: str) -> str:
    edges = list(zip(FOCUS_AREA, FOCUS_AREA[1:]))
    crossings = " + ".join(
        f"(case when ({num(y1)} > {lat}) <> ({num(y2)} > {lat}) and {lon} < "
        f"{num(x2 - x1)} * ({lat} - {num(y1)}) / {num(y2 - y1)} + {num(x1)} then 1 else 0 end)"
        for (x1, y1), (x2, y2) in edges
    )
    return f"(({crossings}) % 2 = 1)"


AREA = inside("Longitude", "Latitude")


def vessel(numbers) -> str:
    prefixes = " or ".join(f"cast(MMSI as varchar) like '{p}%'" for p in EXCLUDED_PREFIXES)
    return f"not coalesce({prefixes} or MMSI in ({', '.join(map(str, numbers))}), false)"


FLAGS = "flags(code, country) as (values " + ", ".join(f"('{c}', '{n}')" for c, n in LOCAL_FLAGS) + ")"
TIMED = """timed as (select *, make_timestamp(timestamp * 1000000) as datetime,
 cast(make_timestamp(timestamp * 1000000) as date) as date,
 cast(year(make_timestamp(timestamp * 1000000)) as integer) as year,
 cast(hour(make_timestamp(timestamp * 1000000)) as integer) as hour from ais)"""
PREPARED = f"""{FLAGS}, {TIMED}, prepared as (select t.*, substr(cast(MMSI as varchar), 1, 3) as MID,
 coalesce(f.country, 'Unknown') as Country
 from timed t left join flags f on f.code = substr(cast(MMSI as varchar), 1, 3)
 where {vessel(EXCLUDED_MMSI)} and {AREA})"""
TRACKED = f"{TIMED}, tracked as (select *, year as track_year from timed)"
SIZES = f"""{TRACKED}, by_type as (select track_year, MMSI, Type, count(*) as n from tracked group by all),
 sizes as (select track_year, MMSI, cast(sum(n) as bigint) as rows,
  (list(Type order by n desc, Type))[1] as modal_type from by_type group by all having sum(n) > 1)"""
TRACKS = f"""{TRACKED}, tracks as (select * from tracked
 where (track_year, MMSI) in (select (track_year, MMSI) from tracked group by track_year, MMSI having count(*) > 1))"""
TRAINING = f"training as (select * from ais where {vessel(EXCLUDED_MMSI_ML)} and {AREA})"
ZONE_EDGES = ", ".join(
    f"('{name}', {num(x1)}, {num(y1)}, {num(x2)}, {num(y2)})"
    for name, rings in shapes() for ring in rings for (x1, y1), (x2, y2) in zip(ring, ring[1:])
)
KEY = "(((((id % 1000003) * 48271 + 12345) % 2147483647) % 1000003) * 48271 + 12345) % 2147483647"
#: The weights of the fixed smoothing, as registered.
SMOOTHING = (0.3, 0.05, 0.2)
WEEK = "cast(date_trunc('week', make_timestamp(timestamp * 1000000)) as date)"
WEEKS = f"""{TRAINING}, weeks as (select 'ALL' as series_key, {WEEK} as week, count(distinct MMSI) as y
 from training group by all),
 marked as (select *, case when week >= date '2023-01-01' then 'test' else 'train' end as split from weeks)"""


def sample(total: int) -> str:
    return f"""{TRAINING}, usable as (select * from training where Type not in (11, 19) and Type is not null),
 quota as (select cast(floor({total} / count(distinct Type)) as bigint) as q from usable),
 sample as (select * from (select *, row_number() over (partition by Type order by {KEY}, id) as r from usable)
  where r <= (select q from quota))"""


SPLIT = f"""{sample(30000)}, parts as (select *, case when
 row_number() over (partition by Type order by {KEY}, id) <= floor(count(*) over (partition by Type) * 0.8e0)
 then 'train' else 'test' end as split from sample)"""
SCALED = SPLIT + ", scaled as (select id, Type, split, " + ", ".join(
    f"({c} - (select avg({c}) from parts where split = 'train')) / "
    f"(select stddev_pop({c}) from parts where split = 'train') as {c}" for c in FEATURES
) + " from parts)"
KNN = SCALED + """, near as (select t.id, t.Type as actual, r.Type as label,
  row_number() over (partition by t.id order by """ + " + ".join(
    f"(t.{c} - r.{c}) * (t.{c} - r.{c})" for c in FEATURES
) + """, r.id) as k
  from scaled t, scaled r where t.split = 'test' and r.split = 'train'),
 votes as (select id, actual, label, count(*) as n from near where k <= 5 group by all),
 knn as (select id, actual, (list(label order by n desc, label))[1] as predicted from votes group by all)"""
REPORT = KNN + """, labels as (select actual as label from knn union select predicted from knn),
 scores as (select label, (select count(*) from knn where actual = label) as support,
  (select count(*) from knn where predicted = label) as said,
  (select count(*) from knn where predicted = label and actual = label) as hits from labels),
 rates as (select cast(label as varchar) as label, support, hits,
  case when said = 0 then 0e0 else hits / cast(said as double) end as precision,
  case when support = 0 then 0e0 else hits / cast(support as double) end as recall,
  case when said + support = 0 then 0e0 else 2e0 * hits / cast(said + support as double) end as f1 from scores),
 report as (select label, support, precision, recall, f1 from rates
  union all select 'accuracy', cast(sum(support) as bigint), sum(hits) / sum(support)::double, sum(hits) / sum(support)::double,
   sum(hits) / sum(support)::double from rates
  union all select 'macro avg', cast(sum(support) as bigint), avg(precision), avg(recall), avg(f1) from rates
  union all select 'weighted avg', cast(sum(support) as bigint), sum(precision * support) / sum(support),
   sum(recall * support) / sum(support), sum(f1 * support) / sum(support) from rates)"""


def utm_sql() -> tuple[str, str]:
    ecc, radius, alphas = krueger_series()
    t = (f"sinh(atanh(sin(radians(Latitude))) - {num(ecc)} * atanh({num(ecc)} * sin(radians(Latitude))))")
    dlon = "radians(Longitude - 15e0)"
    east = " + ".join([f"{num(a)} * cos({2 * j}e0 * xi) * sinh({2 * j}e0 * eta)" for j, a in enumerate(alphas, 1)])
    north = " + ".join([f"{num(a)} * sin({2 * j}e0 * xi) * cosh({2 * j}e0 * eta)" for j, a in enumerate(alphas, 1)])
    angles = f"atan2({t}, cos({dlon})) as xi, atanh(sin({dlon}) / sqrt(1e0 + {t} * {t})) as eta"
    scale = num(SCALE * radius)
    return angles, f"500000e0 + {scale} * (eta + {east}) as Easting, {scale} * (xi + {north}) as Northing"


ANGLES, GRID = utm_sql()
CLUSTER_COLUMNS = ["Easting", "Northing", "Distance", "Bearing"]
POINTS = f"""{TRAINING}, drawn as (select * from training order by {KEY}, id limit 100000),
 single as (select min(id) as id, Latitude, Longitude, Distance, Bearing from drawn
  where Latitude is not null and Longitude is not null and Distance is not null and Bearing is not null
  group by Latitude, Longitude, Distance, Bearing),
 angled as (select *, {ANGLES} from single),
 metric as (select id, {GRID}, Distance, Bearing from angled),
 points as (select id, """ + ", ".join(
    f"({c} - (select avg({c}) from metric)) / (select stddev_pop({c}) from metric) as {c}" for c in CLUSTER_COLUMNS
) + " from metric)"
TYPED = POINTS + ", typed as (select p.*, a.Type as cluster from points p join ais a on a.id = p.id)"
D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in CLUSTER_COLUMNS)
CENTRES = TYPED + ", centres as (select cluster, count(*) as n, " + ", ".join(
    f"avg({c}) as {c}" for c in CLUSTER_COLUMNS
) + " from typed group by cluster)"


def bins_sql(value: str, bins: int, digits: int) -> str:
    width = f"((hi - lo) / {bins})"
    return query(f"""{PREPARED}, vals as (select year, {value} as x from prepared where {value} is not null),
 edges as (select year, case when min(x) = max(x) then min(x) - 0.5e0 else min(x) end as lo,
  case when min(x) = max(x) then max(x) + 0.5e0 else max(x) end as hi from vals group by year),
 placed as (select year, lo, hi, cast(least(floor((x - lo) / {width}), {bins - 1}) as integer) as bin
  from vals join edges using (year))""", f"""select year, bin, round(lo + bin * {width}, {digits}) as lower,
 round(lo + (bin + 1) * {width}, {digits}) as upper, count(*) as rows from placed group by year, bin, lo, hi""")


def density_sql(value: str) -> str:
    return query(f"""{PREPARED}, vals as (select year, {value} as x from prepared where {value} is not null),
 spread as (select year, min(x) as lo, max(x) as hi, count(*) as n,
  stddev_samp(x) * pow(count(*), -0.2e0) as h from vals group by year having stddev_samp(x) > 0),
 grid as (select s.*, point, lo + (hi - lo) * point / 199 as location
  from spread s, (select cast(unnest(range(200)) as integer) as point))""",
        """select g.year, point, round(location, 6) as location,
 round(sum(exp(-0.5e0 * ((location - x) / h) * ((location - x) / h))) / (any_value(n) * any_value(h) * sqrt(2e0 * pi())), 9) as density
 from grid g join vals v on v.year = g.year group by g.year, point, location""")


def describe_sql(by_year: bool) -> str:
    key = "year, " if by_year else ""
    group = " group by year" if by_year else ""
    parts = [
        f"""select {key}'{c}' as column_name, count({c}) as count, round(avg(cast({c} as double)), 4) as mean,
 round(stddev_samp(cast({c} as double)), 2) as std, round(cast(min({c}) as double), 8) as min,
 round(cast(max({c}) as double), 8) as max, round(quantile_cont(cast({c} as double), 0.25), 8) as p25,
 round(quantile_cont(cast({c} as double), 0.5), 8) as p50, round(quantile_cont(cast({c} as double), 0.75), 8) as p75,
 null::bigint as unique, null::varchar as top, null::bigint as freq from prepared{group}"""
        for c in ["id", "timestamp", "MMSI", "Latitude", "Longitude", "Distance", "Bearing", "year", "hour"]
        if not (by_year and c == "year")
    ]
    parts += [
        f"""select {key}'{c}', cast(sum(n) as bigint), null, null, null, null, null, null, null, count(*),
 (list(v order by n desc, v))[1], max(n) from
 (select {key}cast({c} as varchar) as v, count(*) as n from prepared where {c} is not null group by all){group}"""
        for c in ["Type", "date", "MID", "Country"]
    ]
    return query(PREPARED, " union all ".join(parts))


def query(ctes: str, body: str) -> str:
    return f"with {DUCKDB_VIEW}, {ctes} {body}" if ctes else f"with {DUCKDB_VIEW} {body}"


CORRELATED = ["timestamp", "Latitude", "Longitude", "Distance", "Bearing"]
DELTAS = f"""{TRACKED}, deltas as (select track_year, MMSI,
  timestamp - lag(timestamp) over (partition by track_year, MMSI order by timestamp, id) as d from tracked),
 gaps as (select track_year, MMSI, count(*) as rows, avg(d) as mean_s, count(d) as m,
  cast(sum(d) as double) as total, cast(sum(d * d) as double) as squares
  from deltas group by track_year, MMSI having count(d) >= 2 and sum(d) > 0)"""


def popup_sql(fields) -> str:
    parts = [f"'{f}: ' || coalesce(cast({f} as varchar), 'nan')" for f in fields]
    return " || '<br>' || ".join(parts)


def layer_sql(period: str, where: str, fields) -> str:
    return query(PREPARED, f"""select {period}, id, Longitude, Latitude, Type,
 cast(dense_rank() over (partition by {period} order by Type nulls first) - 1 as integer) as colour,
 {popup_sql(fields)} as popup from prepared where Longitude is not null and Latitude is not null{where}""")


def kpss_sql() -> str:
    return query(f"""{WEEKS}, diffs as (select *, y - lag(y) over w as d1 from marked window w as (partition by series_key order by week)),
 diffs2 as (select *, d1 - lag(d1) over w as d2 from diffs window w as (partition by series_key order by week)),
 long as (select series_key, 'level' as transform, week, cast(y as double) as v from diffs2
  union all select series_key, 'diff_1', week, cast(d1 as double) from diffs2 where d1 is not null
  union all select series_key, 'diff_2', week, cast(d2 as double) from diffs2 where d2 is not null),
 e as (select series_key, transform, row_number() over w as t, count(*) over (partition by series_key, transform) as n,
  v - avg(v) over (partition by series_key, transform) as e from long window w as (partition by series_key, transform order by week)),
 cov as (select a.series_key, a.transform, a.n, a.t - b.t as i, sum(a.e * b.e) as c from e a
  join e b on a.series_key = b.series_key and a.transform = b.transform and b.t <= a.t group by all),
 s as (select series_key, transform, n, sum(case when i = 0 then c / n else c / (n / 2e0) end) as s0,
  sum(case when i > 0 then i * c / (n / 2e0) else 0 end) as s1 from cov where i <= floor(pow(n, 2e0 / 9e0)) group by all),
 lag_choice as (select *, cast(least(floor(1.1447e0 * pow((s1 / s0) * (s1 / s0), 1e0 / 3e0) * pow(n, 1e0 / 3e0)), n - 1) as integer) as lags from s),
 lr as (select l.series_key, l.transform, l.n, lags,
  sum(case when i = 0 then c when i <= lags then 2e0 * (1e0 - i / (lags + 1e0)) * c else 0 end / l.n) as lr
  from lag_choice l join cov c on c.series_key = l.series_key and c.transform = l.transform group by all),
 partial as (select series_key, transform, sum(e) over (partition by series_key, transform order by t) as p from e),
 stat as (select lr.series_key, lr.transform, lr.n, lags,
  (select sum(p * p) from partial q where q.series_key = lr.series_key and q.transform = lr.transform) / (cast(n as double) * n * lr) as s from lr)""",
        """select series_key, transform, cast(n as integer) as observations, lags, round(s, 6) as statistic,
 round(case when s <= 0.347 then 0.1 when s <= 0.463 then 0.1 + (s - 0.347) / (0.463 - 0.347) * (0.05 - 0.1)
  when s <= 0.574 then 0.05 + (s - 0.463) / (0.574 - 0.463) * (0.025 - 0.05)
  when s <= 0.739 then 0.025 + (s - 0.574) / (0.739 - 0.574) * (0.01 - 0.025) else 0.01 end, 6) as p_value from stat""")


def map_layer_sql() -> str:
    """Features as text: the points of every day, the area, the antenna and the ports."""
    def drawn(kind: str, coordinates: str, name: str) -> str:
        return f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":{coordinates}}},"properties":{{"name":"{name}"}}}}'

    def ring(points) -> str:
        return "[[" + ",".join(f"[{x!r},{y!r}]" for x, y in points) + "]]"

    fixed = [drawn("Polygon", ring(FOCUS_AREA), "Area of Focus"), drawn("Point", f"[{ANTENNA_LON!r},{ANTENNA_LAT!r}]", "Antenna AIS")]
    fixed += [drawn("Polygon", ring(points), name) for name, points in PORT_ZONES.items()]
    points = layer_sql("date", "", ["MMSI", "Type", "Latitude", "Longitude", "datetime", "Country"])
    return f"""select date, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || Longitude || ',' || Latitude || ']}},"properties":{{"id":'
 || id || coalesce(',"Type":' || Type, '') || ',"colour":' || colour || ',"popup":"' || popup || '"}}}}' as feature from ({points})
union all select null, unnest([{", ".join(f"'{f}'" for f in fixed)}])"""


def adf_sql() -> str:
    """The regression of steps on levels and a constant, in closed form."""
    return query(f"""{WEEKS}, diffs as (select *, y - lag(y) over w as d1 from marked window w as (partition by series_key order by week)),
 diffs2 as (select *, d1 - lag(d1) over w as d2 from diffs window w as (partition by series_key order by week)),
 long as (select series_key, 'level' as transform, week, cast(y as double) as v from diffs2
  union all select series_key, 'diff_1', week, cast(d1 as double) from diffs2 where d1 is not null
  union all select series_key, 'diff_2', week, cast(d2 as double) from diffs2 where d2 is not null),
 steps as (select *, lag(v) over w as x, v - lag(v) over w as step from long window w as (partition by series_key, transform order by week)),
 r as (select series_key, transform, count(step) as n, regr_sxx(step, x) as sxx, regr_syy(step, x) as syy, regr_sxy(step, x) as sxy
  from steps where step is not null group by all having count(step) >= 9)""",
        """select series_key, transform, cast(n as integer) as observations,
 round((sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) as statistic from r""")


def smoothing_sql(m: int = 52) -> str:
    """Additive smoothing week by week, from the means of the first two years."""
    a, b, g = SMOOTHING
    return query(f"""{TRAINING}, weeks as (select 'ALL' as series_key, {WEEK} as week, count(distinct MMSI) as y from training group by all
  union all select 'type ' || Type, {WEEK}, count(distinct MMSI) from training group by all),
 series as (select series_key, list(y::double order by week) filter (week < date '2023-01-01') as y,
  list({{'week': week, 'y': y::double}} order by week) filter (week >= date '2023-01-01') as test from weeks group by series_key),
 state as (select series_key, y, 0 as t, list_avg(y[1:{m}]) as level, (list_avg(y[{m + 1}:{2 * m}]) - list_avg(y[1:{m}])) / {m} as slope,
   list_transform(y[1:{m}], lambda v: v - list_avg(y[1:{m}])) as season from series where len(y) >= {2 * m}
  union all select series_key, y, t + 1, {a} * (y[t + 1] - season[1]) + (1 - {a}) * (level + slope),
   {b} * ({a} * (y[t + 1] - season[1]) + (1 - {a}) * (level + slope) - level) + (1 - {b}) * slope,
   season[2:] || [{g} * (y[t + 1] - level - slope) + (1 - {g}) * season[1]] from state where t < len(y)),
 ahead as (select s.series_key, level, slope, season, unnest(test) as p, unnest(range(1, len(test) + 1)) as h
  from state s join series using (series_key) where t = len(s.y))""",
        f"""select series_key, p.week as week, p.y as y, round(level + slope * h + season[(h - 1) % {m} + 1], 6) as prediction from ahead""").replace("with ", "with recursive ", 1)


ORACLE: dict[str, str] = {
    "traffic_by_country": query(PREPARED, """select year, Country, count(*) as messages,
 count(distinct MMSI) as vessels from prepared group by year, Country"""),
    "focus_area": query("", f"select id, chunk from ais where {AREA}"),
    "identity_filter": query("", f"select id, MMSI from ais where {vessel(EXCLUDED_MMSI)}"),
    "identity_filter_ml": query("", f"select id, MMSI from ais where {vessel(EXCLUDED_MMSI_ML)}"),
    "listed_stations": query("", """select id, MMSI from ais where MMSI not in
 (select MMSI from ais group by MMSI having min(Type) <> max(Type))"""),
    "zone_of_report": query(f"""edges(zone, x1, y1, x2, y2) as (values {ZONE_EDGES}), tested as (select id, zone,
 sum(case when (y1 > Latitude) <> (y2 > Latitude) and Longitude < (x2 - x1) * (Latitude - y1) / (y2 - y1) + x1 then 1 else 0 end) as crossed,
 bool_or((x2 - x1) * (Latitude - y1) - (y2 - y1) * (Longitude - x1) = 0 and Longitude between least(x1, x2) and greatest(x1, x2)
  and Latitude between least(y1, y2) and greatest(y1, y2)) as touched from ais, edges group by id, zone)""",
        "select id, zone from tested where crossed % 2 = 1 and not touched"),
    "bearing_sector": query("", """select id, Bearing from ais where Bearing >= 180 and Bearing <= 270
 and Latitude is not null and Longitude is not null"""),
    "usable_classes": query("", "select id, Type from ais where Type not in (11, 19)"),
    "time_parts": query("""moments as (select id, make_timestamp(timestamp * 1000000) as datetime from ais)""",
        """select id, datetime, cast(datetime as date) as date, cast(year(datetime) as integer) as year,
 cast(month(datetime) as integer) as month, cast(hour(datetime) as integer) as hour, dayname(datetime) as weekday,
 cast(isoyear(datetime) as integer) as iso_year, cast(week(datetime) as integer) as iso_week,
 cast(date_trunc('week', datetime) as date) as week from moments"""),
    "flag_country": query(FLAGS, """select id, MMSI, substr(cast(MMSI as varchar), 1, 3) as MID,
 coalesce(country, 'Unknown') as Country from ais left join flags on code = substr(cast(MMSI as varchar), 1, 3)"""),
    "station_flag": query("", """select id, cast(MMSI as varchar) like '00%' or cast(MMSI as varchar) like '99%' as station,
 lpad(cast(MMSI as varchar), 9, '0') like '00%' or lpad(cast(MMSI as varchar), 9, '0') like '99%' as station_padded from ais"""),
    "numeric_columns": query("", """select timestamp, round(Latitude, 9) as Latitude, round(Longitude, 9) as Longitude,
 round(Distance, 9) as Distance, round(Bearing, 9) as Bearing, Type, chunk from ais"""),
    "popup_and_units": query("", f"""select id, {popup_sql(["MMSI", "Type"])} as popup,
 round(Distance / 1000e0, 9) as distance_km, round(radians(Bearing), 9) as bearing_rad from ais"""),
    "filter_audit": query("", f"""select 'all' as stage, count(*) as rows from ais
 union all select 'focus_area', count(*) from ais where {AREA}
 union all select 'focus_area_and_identity', count(*) from ais where {AREA} and {vessel(EXCLUDED_MMSI)}"""),
    "source_subset": query("", """select chunk, id from ais where chunk in
 (select distinct chunk from ais order by chunk limit 10)"""),
    "class_counts": query("""counted as (select Type, count(*) as rows from ais where Type not in (11, 19) group by Type)""",
        """select Type, rows, cast(floor(30000 / (select count(*) from counted)) as bigint) as quota from counted"""),
    "vessel_types_by_year": query(PREPARED, """select year, Type, count(*) as vessels from
 (select year, Type, row_number() over (partition by year, MMSI order by id) as r from prepared) where r = 1 group by year, Type"""),
    "messages_daily": query(PREPARED, "select year, date, count(*) as messages from prepared group by year, date"),
    "messages_hourly": query(PREPARED, "select year, hour, count(*) as messages from prepared group by year, hour"),
    "messages_hourly_all": query(TIMED, "select hour, count(*) as messages from timed group by hour"),
    "messages_weekday": query(TIMED, "select dayname(datetime) as weekday, count(*) as messages from timed group by 1"),
    "distinct_dates": query(PREPARED, "select distinct date from prepared order by date"),
    "describe_global": describe_sql(False),
    "describe_by_year": describe_sql(True),
    "correlation_by_year": query(PREPARED, " union all ".join(
        f"select year, '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 9) as correlation from prepared group by year"
        for a in CORRELATED for b in CORRELATED)),
    **{f"hist_{c.lower()}": bins_sql(c, n, 9) for c, n in HISTOGRAM_BINS.items()},
    "hist_bearing_polar": bins_sql("radians(Bearing)", 360, 9),
    "density_bearing": density_sql("Bearing"),
    "density_latitude": density_sql("Latitude"),
    "tracks": query(TRACKS, "select track_year, MMSI, id, timestamp from tracks"),
    "track_sizes": query(SIZES, """select track_year, MMSI, rows, modal_type,
 case when rows <= 10 then 'small' else 'large' end as size_class from sizes"""),
    "small_tracks": query(SIZES, """select t.track_year, t.MMSI, t.id from tracked t join sizes s
 on s.track_year = t.track_year and s.MMSI = t.MMSI where s.rows <= 10"""),
    "track_size_thresholds": query(SIZES, " union all ".join(
        f"select {t} as threshold, count(*) as tracks from sizes where rows > {t}" for t in TRACK_SIZE_THRESHOLDS)),
    "reporting_gaps": query(DELTAS, """select track_year, MMSI, rows, round(mean_s / 3600e0, 9) as mean_h,
 round((squares - total * total / m) / (m - 1) / (3600e0 * 3600e0), 6) as variance_h2 from gaps"""),
    "gap_threshold_census": query(DELTAS, " union all ".join(
        f"""select '{unit}' as unit, {t} as threshold, count(*) filter (mean_s / {s}e0 < {t}) as less,
 count(*) filter (mean_s / {s}e0 = {t}) as equal, count(*) filter (mean_s / {s}e0 > {t}) as greater from gaps"""
        for unit, s, ts in GAP_THRESHOLDS for t in ts)),
    "track_box_stats": query(SIZES + """, box as (select modal_type as Type, quantile_cont(cast(rows as double), 0.25) as q1,
  quantile_cont(cast(rows as double), 0.5) as median, quantile_cont(cast(rows as double), 0.75) as q3 from sizes group by 1)""",
        """select Type, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
 cast(min(rows) as double) as whisker_low, cast(max(rows) as double) as whisker_high from sizes join box on Type = modal_type
 where rows >= q1 - 1.5 * (q3 - q1) and rows <= q3 + 1.5 * (q3 - q1) group by all"""),
    "week_by_weekday": query(TRACKS + """, w as (select cast(isoyear(datetime) as integer) as iso_year,
  cast(week(datetime) as integer) as iso_week, cast(month(datetime) as integer) as month, dayname(datetime) as weekday from tracks),
 months as (select iso_year, iso_week, month, count(*) as n from w group by all),
 modal as (select iso_year, iso_week, (list(month order by n desc, month))[1] as month from months group by all),
 days as (select unnest([""" + texts(WEEKDAYS) + """]) as weekday)""",
        """select m.iso_year, m.iso_week, m.month, d.weekday, count(w.weekday) as messages from modal m cross join days d
 left join w on w.iso_year = m.iso_year and w.iso_week = m.iso_week and w.weekday = d.weekday group by all"""),
    "new_tracks_only": query(TRACKS, "select track_year, MMSI, id from tracks where track_year >= 2022"),
    "saved_and_skipped": query(TRACKS + ", keys as (select distinct track_year, MMSI from tracks)",
        """select count(*) filter (track_year >= 2022) as saved, count(*) filter (track_year < 2022) as skipped from keys"""),
    "weekly_vessels_per_source": query(TRAINING, f"""select 'ALL' as series_key, week, cast(sum(y) as bigint) as y from
 (select {WEEK} as week, chunk, count(distinct MMSI) as y from training group by all) group by week"""),
    "weekly_vessels_distinct": query(WEEKS, "select series_key, week, y from weeks"),
    "weekly_vessels_by_country": query(PREPARED, f"""select Country as series_key, {WEEK} as week,
 count(distinct MMSI) as y from prepared group by all"""),
    "lag_features": query(WEEKS, """select * from (select *, lag(y, 1) over w as lag_1, lag(y, 2) over w as lag_2,
 lag(y, 3) over w as lag_3, lag(y, 4) over w as lag_4 from marked window w as (partition by series_key order by week))
 where lag_4 is not null"""),
    "differences": query(WEEKS + ", d as (select *, y - lag(y) over (partition by series_key order by week) as diff_1 from marked)",
        "select *, diff_1 - lag(diff_1) over (partition by series_key order by week) as diff_2 from d"),
    "train_test_by_date": query(WEEKS, "select * from marked"),
    "chronological_split": query(WEEKS, """select series_key, week, y, case when row_number() over (order by week) >
 count(*) over () - floor(count(*) over () * 0.1e0) then 'validate' else 'fit' end as split from weeks"""),
    "kpss": kpss_sql(),
    "adf_without_lags": adf_sql(),
    "smoothing_fixed": smoothing_sql(),
    "naive_forecast_metrics": query(WEEKS + ", f as (select *, lag(y) over (order by week) as p from marked)",
        """select series_key, 'lag_1' as model, round(avg(abs(y - p)), 6) as mae, round(sqrt(avg((y - p) * (y - p))), 6) as rmse,
 round(avg(case when y <> 0 then abs((y - p) / y::double) end) * 100, 6) as mape from f where split = 'test' group by series_key"""),
    "daily_map_points": layer_sql("date", "", ["MMSI", "Type", "Latitude", "Longitude", "datetime", "Country"]),
    "bearing_map_points": layer_sql("year", " and Bearing >= 180 and Bearing <= 270",
        ["MMSI", "Type", "Latitude", "Longitude", "datetime", "Country", "Bearing"]),
    "daily_map_layer": map_layer_sql(),
    "dataset_census": query(SIZES + """, files as (select case when rows <= 10 then 'tracks_small' else 'tracks_large' end as stage,
  'vessel_track_' || track_year || '_' || MMSI || '.csv' as name from sizes
  union all select distinct 'csv', 'ais_data_' || track_year || '_p_' || chunk || '.csv' from tracked),
 stages as (select unnest(['dumps', 'csv', 'tracks_small', 'tracks_large']) as stage),
 years as (select unnest([2020, 2021, 2022, 2023, null]) as year)""",
        """select s.stage, cast(y.year as integer) as year, count(f.name) as files from stages s cross join years y left join files f
 on f.stage = s.stage and (y.year is null or contains(f.name, cast(y.year as varchar))) group by all"""),
    "balanced_sample": query(sample(30000), "select id, Type from sample"),
    "fixed_sample": query(TRAINING, f"select id from training order by {KEY}, id limit 5000"),
    "stratified_split": query(SPLIT, "select id, Type, split from parts"),
    "split_counts": query(SPLIT, "select split, Type, count(*) as rows from parts group by all"),
    "class_weights": query(SPLIT, """select Type, round(sum(count(*)) over () / (count(*) over () * count(*)::double), 9) as weight
 from parts where split = 'train' group by Type"""),
    "standardised": query(SCALED, "select id, " + ", ".join(f"round({c}, 9) as {c}" for c in FEATURES) + " from scaled where split = 'test'"),
    "minmax_scaled": query(SPLIT, "select id, " + ", ".join(
        f"round(({c} - (select min({c}) from parts where split = 'train')) / "
        f"(select max({c}) - min({c}) from parts where split = 'train'), 9) as {c}" for c in FEATURES
    ) + " from parts where split = 'test'"),
    "knn_predictions": query(KNN, "select id, actual, predicted from knn"),
    "confusion_matrix": query(KNN + ", labels as (select actual as l from knn union select predicted from knn)",
        """select a.l as actual, p.l as predicted, count(k.id) as rows from labels a cross join labels p
 left join knn k on k.actual = a.l and k.predicted = p.l group by all"""),
    "classification_report": query(REPORT, """select label, support, round(precision, 9) as precision, round(recall, 9) as recall,
 round(f1, 9) as f1 from report"""),
    "accuracy": query(KNN, "select round(avg(case when actual = predicted then 1e0 else 0e0 end), 9) as accuracy from knn"),
    "haversine_to_antenna": query(f"""h as (select id,
  sin(radians({num(ANTENNA_LAT)} - Latitude) / 2) * sin(radians({num(ANTENNA_LAT)} - Latitude) / 2) +
  cos(radians(Latitude)) * cos(radians({num(ANTENNA_LAT)})) * sin(radians({num(ANTENNA_LON)} - Longitude) / 2)
  * sin(radians({num(ANTENNA_LON)} - Longitude) / 2) as a from ais)""",
        "select id, round(6371e0 * 2e0 * atan2(sqrt(a), sqrt(1e0 - a)), 6) as km from h"),
    "utm_coordinates": query(f"angled as (select id, {ANGLES} from ais), metric as (select id, {GRID} from angled)",
        "select id, round(Easting, 3) as Easting, round(Northing, 3) as Northing from metric"),
    "cluster_input": query(POINTS, "select id, " + ", ".join(f"round({c}, 6) as {c}" for c in CLUSTER_COLUMNS) + " from points"),
    "eps_neighbour_counts": query(POINTS, f"""select a.id, count(*) as neighbours, count(*) >= 5 as core
 from points a join points b on {D2} <= 0.25e0 group by a.id"""),
    "cluster_sizes": query(TYPED, "select cluster, count(*) as rows from typed group by cluster"),
    "silhouette_exact": query(TYPED + f""", sums as (select a.id, a.cluster as own, b.cluster, sum(sqrt({D2})) as total, count(*) as n
  from typed a, typed b group by all),
 ab as (select id, max(case when own = cluster and n > 1 then total / (n - 1) end) as a,
  min(case when own <> cluster then total / n end) as b from sums group by id)""",
        "select round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) as silhouette from ab"),
    "silhouette_squared": query(TYPED + f""", sums as (select a.id, a.cluster as own, b.cluster, sum({D2}) as total, count(*) as n
  from typed a, typed b group by all),
 ab as (select id, max(case when own = cluster and n > 1 then total / (n - 1) end) as a,
  min(case when own <> cluster then total / n end) as b from sums group by id)""",
        "select round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) as silhouette_squared from ab"),
    "calinski_harabasz": query(CENTRES + f""", whole as (select {", ".join(f"avg({c}) as {c}" for c in CLUSTER_COLUMNS)} from typed),
 between_ as (select sum(a.n * ({D2})) as s, count(*) as k, sum(a.n) as n from centres a, whole b),
 within_ as (select sum({D2}) as s from typed a join centres b on a.cluster = b.cluster)""",
        "select round((b.s / (b.k - 1)) / (w.s / (b.n - b.k)), 6) as calinski_harabasz from between_ b, within_ w"),
    "davies_bouldin": query(CENTRES + f""", spread as (select a.cluster, avg(sqrt({D2})) as s from typed a join centres b
  on a.cluster = b.cluster group by a.cluster),
 ratios as (select a.cluster, max((p.s + q.s) / sqrt({D2})) as worst from centres a join centres b on a.cluster <> b.cluster
  join spread p on p.cluster = a.cluster join spread q on q.cluster = b.cluster group by a.cluster)""",
        "select round(avg(worst), 6) as davies_bouldin from ratios"),
}
