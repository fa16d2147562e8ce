"""Registered queries of the track, field and forecast operators, each with the SQL of the same result.

Floats are rounded to six places in both, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bins, geo
from tidemark.operators import bootstrap, cregress, field, forecast, profile, resample, selection, spectra, tracks, verify
from tidemark.plans import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def hav(a: str, b: str, c: str, d: str) -> str:
    inner = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"(CASE WHEN {inner} IS NOT NULL THEN 2 * {geo.EARTH_RADIUS_KM} * asin(sqrt(least(1.0, greatest(0.0, {inner})))) END)"


def drawn(resample: str, draw: str, n: str) -> str:
    """SQL of bootstrap.drawn_index() with seed 1."""
    k = f"((({resample} * 7919 + {draw} * 104729 + 1) * 48271) % {bootstrap.PRIME})"
    return f"((({k} * {k}) % {bootstrap.PRIME} * {k} + {k}) % {bootstrap.PRIME} % {n})"


B = views.BOX
#: Named parts of the SQL; each may use those before it.
PARTS = {
    "fixes": f"""SELECT user_id AS buoy_id, event_id AS fix_id, ts,
      -164.2 + abs((s + user_id * 86413) % 3456000 - 1728000) / 432000.0::DOUBLE + ((event_id * 7919) % 101 - 50) / 5000.0::DOUBLE AS lon,
      4.4 + abs((s + user_id * 50021) % 2592000 - 1296000) / 370000.0::DOUBLE + ((event_id * 104729) % 97 - 48) / 5000.0::DOUBLE AS lat
      FROM (SELECT *, epoch_us(ts) // 1000000 - {views.EPOCH} AS s FROM events)""",
    "legs0": """SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt_s
      FROM fixes WINDOW w AS (PARTITION BY buoy_id ORDER BY ts, fix_id)""",
    "legs1": f"""SELECT *, lon - lon0 AS dx_deg, lat - lat0 AS dy_deg, sign(lon - lon0) * {hav('lat0', 'lon0', 'lat0', 'lon')} AS x_km,
      sign(lat - lat0) * {hav('lat0', 'lon0', 'lat', 'lon0')} AS y_km, {hav('lat0', 'lon0', 'lat', 'lon')} AS xy_km FROM legs0""",
    "legs": "SELECT *, x_km * 1000 / nullif(dt_s, 0) AS u, y_km * 1000 / nullif(dt_s, 0) AS v, xy_km * 1000 / nullif(dt_s, 0) AS speed FROM legs1",
    "masked": f"""SELECT *, coalesce(NOT (speed > {tracks.FASTEST} OR speed < {tracks.SLOWEST}), true) AS ok_speed, coalesce(dt_s <> 0, true) AS ok_time FROM legs""",
    "cleaned": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY buoy_id) AS n_left FROM masked WHERE lon0 IS NOT NULL AND ok_speed AND ok_time) WHERE n_left > 1""",
    "inside": f"""SELECT *, lon > {B[0]} AND lon < {B[1]} AND lat > {B[2]} AND lat < {B[3]} AS i FROM fixes""",
    "islands": """SELECT *, sum(CASE WHEN i AND NOT coalesce(li, false) THEN 1 ELSE 0 END) OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) AS run
      FROM (SELECT *, lag(i) OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) AS li FROM inside)""",
    "domain": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY buoy_id, run) AS run_len FROM islands WHERE i) WHERE run_len >= 2""",
    "spans": "SELECT buoy_id, min(ts) AS entry_ts, max(ts) AS exit_ts, min(lon) AS lon0, max(lon) AS lon1, min(lat) AS lat0, max(lat) AS lat1 FROM fixes GROUP BY buoy_id",
    "run0": "SELECT buoy_id, ts::DATE AS day, min(ts) AS start_ts FROM fixes GROUP BY ALL",
    "runs": """SELECT f.buoy_id, r.start_ts, r.day, f.ts, f.fix_id, (epoch_us(f.ts) / 1e6 - epoch_us(r.start_ts) / 1e6) / 3600 AS lead_h, f.lat AS lat_true, f.lon AS lon_true
      FROM fixes f JOIN run0 r ON f.buoy_id = r.buoy_id AND f.ts >= r.start_ts AND f.ts <= (r.day + 8)::TIMESTAMP""",
    "still": """SELECT *, first_value(lat_true) OVER w AS lat_fc, first_value(lon_true) OVER w AS lon_fc FROM runs WINDOW w AS (PARTITION BY buoy_id, start_ts ORDER BY lead_h, fix_id)""",
    "errors": f"SELECT *, {hav('lat_true', 'lon_true', 'lat_fc', 'lon_fc')} AS error_km FROM still",
    "binned": "SELECT *, (ceil(lead_h / 4) - 1)::INT AS bin FROM errors WHERE lead_h > 0 AND lead_h <= 192",
    "grid": """SELECT make_timestamp((1704067200 + it * 86400) * 1000000) AS time, 4.0 + iy * 0.25 AS lat, -164.5 + ix * 0.25 AS lon,
      (7 * ix - 5 * iy + 3 * it) / 256.0 AS u, (2 * ix + 3 * iy - 4 * it) / 256.0 AS v
      FROM (SELECT unnest(range(32)) AS it), (SELECT unnest(range(18)) AS iy), (SELECT unnest(range(19)) AS ix)""",
    "sampled": """SELECT ts::DATE::TIMESTAMP AS time, floor(lat * 2) / 2 AS lat, floor(lon * 2) / 2 AS lon, avg((fix_id % 101 - 50) / 64.0::DOUBLE) AS u, avg((fix_id % 89 - 44) / 64.0::DOUBLE) AS v FROM fixes GROUP BY ALL""",
    "zonal": "SELECT time, lat, avg(u) AS u FROM sampled GROUP BY ALL",
}


def _with(sql: str) -> str:
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in PARTS.items()) + "\n" + sql


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places by the same arithmetic as r(), and dates as text, for comparison with SQL."""
    made = {"double": lambda c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6, "date": lambda c: F.col(c).cast("string")}
    return df.select(*[made[t](c).alias(c) if t in made else F.col(c) for c, t in df.dtypes])


#: Queries with a date column, which becomes text.
_DATED = {"d6", "d7", "b12", "f1", "f4", "f5", "g7", "g8", "g17", "g18", "g19"}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query over (spark, sf_dir), and the SQL of its result over the named parts."""

    def keep(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
        if sql:
            dated = name.split("_")[0] in _DATED
            ORACLE_SQL[name] = _with(f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ({sql})" if dated else sql)
        return f

    return keep


def fq(name: str, sql: str | None = None) -> Callable:
    """As query(), of a function of the fixes."""

    def keep(f: Callable[[DataFrame], DataFrame]) -> Callable:
        query(name, sql)(lambda spark, sf_dir: f(views.fixes(spark, sf_dir)))
        return f

    return keep


def r(*columns: str) -> str:
    return ", ".join(f"floor(({c.rpartition(' AS ')[0] or c}) * 1e6 + 0.5) / 1e6 AS {c.rpartition(' AS ')[2]}" for c in columns)


KEY = "buoy_id, fix_id"

fq("c1_entry_exit", f"SELECT {KEY}, min(ts) OVER w AS entry_ts, max(ts) OVER w AS exit_ts FROM fixes WINDOW w AS (PARTITION BY buoy_id)")(
    lambda f: tracks.entry_exit(f).select("buoy_id", "fix_id", F.col("entry_ts").cast("timestamp_ntz").alias("entry_ts"), F.col("exit_ts").cast("timestamp_ntz").alias("exit_ts"))
)
fq("c2_c3_position_dedupe", f"SELECT DISTINCT {KEY}, {r('lon', 'lat')} FROM fixes WHERE lat IS NOT NULL")(lambda f: tracks.exact_dedupe(tracks.with_position(f.union(f))).select("buoy_id", "fix_id", "lon", "lat"))
fq("c4_build_tracks", "SELECT buoy_id, count(*) AS n, list(fix_id ORDER BY ts, fix_id)[1] AS first_fix FROM fixes GROUP BY buoy_id HAVING count(*) > 1")(
    lambda f: tracks.build_tracks(f).select("buoy_id", "n", F.col("pts")[0]["fix_id"].alias("first_fix"))
)
fq("c5_explode_tracks", f"SELECT {KEY}, {r('lon')} FROM (SELECT *, lead(fix_id) OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) AS nx FROM fixes) WHERE nx IS NOT NULL")(
    lambda f: tracks.explode_tracks(tracks.build_tracks(f), drop_last=True).select("buoy_id", "fix_id", "lon")
)
fq("c6_domain_runs", f"SELECT {KEY}, run::BIGINT AS run, run_len FROM domain")(lambda f: tracks.domain_runs(f, box=B).select("buoy_id", "fix_id", "run", "run_len"))
fq("c6_polygon_runs", "SELECT buoy_id, count(*) AS n, max(run_len) AS longest FROM domain GROUP BY buoy_id")(
    lambda f: tracks.domain_runs(f, polygon=[(B[0], B[2]), (B[1], B[2]), (B[1], B[3]), (B[0], B[3])]).groupBy("buoy_id").agg(F.count("*").alias("n"), F.max("run_len").alias("longest"))
)
fq("c7_touching_domain", "SELECT buoy_id, count(*) AS n FROM fixes WHERE buoy_id IN (SELECT buoy_id FROM domain) GROUP BY buoy_id")(lambda f: tracks.touching_domain(f, box=B).groupBy("buoy_id").agg(F.count("*").alias("n")))
fq("c8_c9_c10_legs", f"SELECT {KEY}, {r('dx_deg', 'dy_deg', 'x_km', 'y_km', 'xy_km', 'dt_s', 'u', 'v', 'speed')} FROM legs")(
    lambda f: tracks.legs(f).select("buoy_id", "fix_id", "dx_deg", "dy_deg", "x_km", "y_km", "xy_km", "dt_s", "u", "v", "speed")
)
fq("c8_legs_legacy_axes", f"SELECT {KEY}, floor(sign(lon - lon0) * {hav('lon0', 'lat0', 'lon', 'lat0')} * 1e6 + 0.5) / 1e6 AS x_km, floor(sign(lat - lat0) * {hav('lon0', 'lat0', 'lon0', 'lat')} * 1e6 + 0.5) / 1e6 AS y_km FROM legs0")(
    lambda f: tracks.legs(f, legacy_axis_order=True).select("buoy_id", "fix_id", "x_km", "y_km")
)
_RATE = "SELECT buoy_id, min(ts) AS start_ts, count(*) AS n, (epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6) / 86400 AS days FROM fixes GROUP BY buoy_id"
fq("c11_sampling_rate", f"SELECT buoy_id, n, {r('days', 'days / n * 24 AS rate_h')} FROM ({_RATE})")(lambda f: tracks.sampling_rate(f).select("buoy_id", "n", "days", "rate_h"))
fq("c11_synthetic_times", f"""SELECT buoy_id, fix_id, round((epoch_us(start_ts) + round(i * (days / n * 24) * 3.6e9)::BIGINT - {views.EPOCH}000000) / 1e6, 3) AS even_s
  FROM (SELECT *, row_number() OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) - 1 AS i FROM fixes) JOIN ({_RATE}) USING (buoy_id)""")(
    lambda f: tracks.synthetic_times(f).select("buoy_id", "fix_id", F.round((F.unix_micros("even_ts") - views.EPOCH * 1_000_000) / 1e6, 3).alias("even_s"))
)
fq("c12_sampled_speed", f"SELECT {KEY}, floor(xy_km / nullif(days / n * 24, 0) / 3.6 * 1e6 + 0.5) / 1e6 AS sampled_speed FROM legs JOIN ({_RATE}) USING (buoy_id)")(lambda f: tracks.sampled_speed(f).select("buoy_id", "fix_id", "sampled_speed"))
fq("c13_c14_c15_masks", f"SELECT {KEY}, ok_speed AND ok_time AS ok, count(*) FILTER (NOT ok_speed) OVER (PARTITION BY buoy_id) AS points_removed, count(*) FILTER (NOT ok_time) OVER (PARTITION BY buoy_id) AS points_removed2 FROM masked")(
    lambda f: tracks.masked(f).select("buoy_id", "fix_id", "ok", "points_removed", "points_removed2")
)
fq("c16_clean", f"SELECT {KEY}, {r('u', 'v', 'speed')} FROM cleaned")(lambda f: tracks.clean(f).select("buoy_id", "fix_id", "u", "v", "speed"))
fq("c17_drifters", f"""SELECT buoy_id, fix_id, {r('xy_km')} FROM (SELECT buoy_id, fix_id, {hav('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS xy_km FROM
  (SELECT * FROM fixes WHERE lon BETWEEN {B[0]} AND {B[1]} AND lat BETWEEN {B[2]} AND {B[3]}) WINDOW w AS (PARTITION BY buoy_id ORDER BY ts, fix_id)) WHERE xy_km IS NOT NULL""")(
    lambda f: tracks.normalise_drifters(f.withColumn("lon", F.col("lon") + 360), box=B).select("buoy_id", "fix_id", "xy_km")
)
fq("c18_with_times", f"SELECT {KEY} FROM fixes")(lambda f: tracks.with_times(f).select("buoy_id", "fix_id"))
fq("c19_quality_report", f"""SELECT count(*) AS legs, {r('count(*) FILTER (speed > 2) * 100.0::DOUBLE / count(*) AS fast_pct', 'count(*) FILTER (speed < 0.0001) * 100.0::DOUBLE / count(*) AS slow_pct')},
  count(*) FILTER (NOT ok_speed) AS removed_speed, count(*) FILTER (NOT ok_time) AS removed_time, count(*) FILTER (speed IS NULL) AS no_speed, {r('max(speed) AS max_speed')} FROM masked WHERE lon0 IS NOT NULL""")(tracks.quality_report)
fq("c20_repeated_names", f"SELECT {KEY} FROM fixes WHERE buoy_id IN (SELECT buoy_id FROM fixes GROUP BY buoy_id HAVING count(*) > 1)")(lambda f: tracks.repeated_names(f).select("buoy_id", "fix_id"))
fq("c21_heading", f"SELECT {KEY}, {r('CASE WHEN dx_deg <> 0 OR dy_deg <> 0 THEN cos(atan2(y_km, x_km)) END AS hx', 'CASE WHEN dx_deg <> 0 OR dy_deg <> 0 THEN sin(atan2(y_km, x_km)) END AS hy')} FROM legs")(
    lambda f: tracks.legs(f).select("buoy_id", "fix_id", *[h.alias(n) for h, n in zip(geo.heading(F.col("x_km"), F.col("y_km")), ("hx", "hy"), strict=True)])
)
fq("c22_rolling_speed", f"SELECT {KEY}, floor(avg(speed) OVER (PARTITION BY buoy_id ORDER BY ts, fix_id ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) * 1e6 + 0.5) / 1e6 AS smooth FROM legs")(
    lambda f: tracks.rolling_mean(tracks.legs(f), "speed", "smooth").select("buoy_id", "fix_id", "smooth")
)
_MU = "sin(fix_id % 50)"
fq("c23_c24_c25_model_difference", f"""SELECT {KEY}, {r('lag(mu) OVER w - u AS diff_u', 'lag(mv) OVER w - v AS diff_v', 'sqrt(mu * mu + mv * mv) AS size')}
  FROM (SELECT *, {_MU} AS mu, cos(fix_id % 50) / 2 AS mv FROM legs) WINDOW w AS (PARTITION BY buoy_id ORDER BY ts, fix_id)""")(
    lambda f: tracks.model_difference(tracks.legs(f).withColumns({"mu": F.sin(F.col("fix_id") % 50), "mv": F.cos(F.col("fix_id") % 50) / 2}), "mu", "mv")
    .withColumn("size", tracks.magnitude(F.col("mu"), F.col("mv")))
    .select("buoy_id", "fix_id", "diff_u", "diff_v", "size")
)
fq("c26_month", "SELECT mon_min::INT AS mon_min, count(*) AS n FROM (SELECT month(min(ts) OVER (PARTITION BY buoy_id)) AS mon_min FROM fixes) GROUP BY ALL")(lambda f: tracks.with_month(f).groupBy("mon_min").agg(F.count("*").alias("n")))
fq("c27_c28_distances", f"SELECT {KEY}, {r('xy_km', '(CASE WHEN lat < lat0 THEN -1 ELSE 1 END) * (CASE WHEN lon < lon0 THEN -1 ELSE 1 END) * xy_km AS signed_km')} FROM legs")(
    lambda f: tracks.legs(f).select("buoy_id", "fix_id", "xy_km", geo.signed_haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon")).alias("signed_km"))
)
_S = views.SITE
fq("c29_closest_approach", f"""WITH_P SELECT buoy_id, {r(hav('y', 'x', str(_S[1]), f'({_S[0]})') + ' AS km')} FROM (
  SELECT buoy_id, arg_min(x, d) AS x, arg_min(y, d) AS y FROM (SELECT *, pow(x - ({_S[0]}), 2) + pow(y - {_S[1]}, 2) AS d FROM (
  SELECT buoy_id, lon0 + t * dx_deg AS x, lat0 + t * dy_deg AS y FROM (SELECT *, coalesce(greatest(0.0, least(1.0, ((({_S[0]}) - lon0) * dx_deg + ({_S[1]} - lat0) * dy_deg) / nullif(dx_deg * dx_deg + dy_deg * dy_deg, 0))), 0.0) AS t
  FROM legs WHERE lon0 IS NOT NULL))) GROUP BY buoy_id)""".replace("WITH_P ", ""))(lambda f: tracks.closest_approach(f, _S).select("buoy_id", "km"))

T0, T1 = "2024-01-10 12:00:00", "2024-01-12 12:00:00"
fq("d1_active_at", f"SELECT buoy_id FROM spans WHERE entry_ts <= TIMESTAMP '{T0}' AND exit_ts >= TIMESTAMP '{T0}'")(lambda f: selection.active_at(selection.spans(f), T0).select("buoy_id"))
fq("d2_active_in", f"SELECT buoy_id FROM spans WHERE entry_ts <= TIMESTAMP '{T1}' AND exit_ts >= TIMESTAMP '{T0}'")(lambda f: selection.active_in(selection.spans(f), T0, T1).select("buoy_id"))
fq("d3_select_fixes", f"SELECT {KEY} FROM fixes WHERE ts > TIMESTAMP '{T0}' AND ts < TIMESTAMP '{T1}' AND lon BETWEEN {B[0]} AND {B[1]} AND lat BETWEEN {B[2]} AND {B[3]}")(
    lambda f: selection.select_fixes(f, after=T0, before=T1, box=B).select("buoy_id", "fix_id")
)
fq("d4_extent_overlap", "SELECT buoy_id FROM spans WHERE lat0 <= 5.0 AND lat1 >= 4.6")(lambda f: selection.any_part_in(f, lat=(4.6, 5.0)))
fq("d4_line_meets_box", f"""SELECT DISTINCT buoy_id FROM (SELECT *, greatest(0.0, least(tx0, tx1), least(ty0, ty1)) AS lo, least(1.0, greatest(tx0, tx1), greatest(ty0, ty1)) AS hi
  FROM (SELECT *, (-162.2 - lon0) / dx_deg AS tx0, (-162.0 - lon0) / dx_deg AS tx1, (5.8 - lat0) / dy_deg AS ty0, (6.0 - lat0) / dy_deg AS ty1 FROM legs WHERE lon0 IS NOT NULL)) WHERE lo <= hi""")(
    lambda f: selection.any_part_in(f, lon=(-162.2, -162.0), lat=(5.8, 6.0))
)
fq("d5_one_track", "SELECT fix_id, " + r("lat AS lat_true", "lon AS lon_true") + " FROM fixes WHERE buoy_id = 7")(lambda f: f.where("buoy_id = 7").select("fix_id", F.col("lat").alias("lat_true"), F.col("lon").alias("lon_true")))
fq("d6_active_by_events", """SELECT day::DATE AS day, (sum(coalesce(d, 0)) OVER (ORDER BY day))::BIGINT AS active FROM (SELECT unnest(generate_series((SELECT min(entry_ts)::DATE FROM spans), (SELECT max(exit_ts)::DATE FROM spans), INTERVAL 1 DAY))::DATE AS day)
  LEFT JOIN (SELECT day, sum(d) AS d FROM (SELECT entry_ts::DATE AS day, 1 AS d FROM spans UNION ALL SELECT exit_ts::DATE, -1 FROM spans) GROUP BY day) USING (day)""")(selection.active_by_events)
fq("d7_active_by_observation", "SELECT ts::DATE AS day, count(DISTINCT buoy_id) AS active, year(min(ts))::INT AS year FROM fixes GROUP BY ts::DATE")(selection.active_by_observation)
D8 = """SELECT * FROM (SELECT *, max(day) OVER (PARTITION BY buoy_id) AS last_day FROM (SELECT *, ts::DATE AS day FROM fixes WHERE ts < TIMESTAMP '2024-01-20')) WHERE last_day = DATE '2024-01-19'"""
fq("d8_latest_segments", f"""SELECT {KEY}, segment::BIGINT AS segment FROM (SELECT *, max(segment) OVER (PARTITION BY buoy_id) AS top FROM (
  SELECT *, sum(CASE WHEN day - before >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) AS segment FROM (
  SELECT *, lag(day) OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) AS before FROM ({D8})))) WHERE segment = top""")(lambda f: selection.latest_segments(f, "2024-01-20").select("buoy_id", "fix_id", "segment"))
fq("d9_last_fixes", f"SELECT buoy_id, {r('arg_max(lon, (ts, fix_id)) AS lon', 'arg_max(lat, (ts, fix_id)) AS lat')} FROM fixes GROUP BY buoy_id")(selection.last_fixes)
fq("d9_mean_centre", f"SELECT {r('avg(lon) AS lon', 'avg(lat) AS lat')} FROM (SELECT arg_max(lon, (ts, fix_id)) AS lon, arg_max(lat, (ts, fix_id)) AS lat FROM fixes GROUP BY buoy_id)")(lambda f: selection.mean_centre(selection.last_fixes(f)))
fq("d10_clip", f"SELECT buoy_id, fix_id FROM (SELECT *, count(*) OVER (PARTITION BY buoy_id) AS n FROM fixes WHERE ts BETWEEN TIMESTAMP '{T0}' AND TIMESTAMP '{T1}') WHERE n > 1")(lambda f: selection.clip(f, T0, T1).select("buoy_id", "fix_id"))
fq("d11_subset", f"SELECT {KEY} FROM fixes WHERE buoy_id IN (SELECT buoy_id FROM fixes GROUP BY buoy_id HAVING max(lat) > 7.5)")(
    lambda f: selection.subset(f, f.groupBy("buoy_id").agg(F.max("lat").alias("m")).where("m > 7.5")).select("buoy_id", "fix_id")
)
fq("d12_within_fields", "SELECT buoy_id FROM spans WHERE entry_ts > (SELECT max(a) FROM (SELECT min(ts) AS a FROM fixes GROUP BY fix_id % 3)) AND exit_ts < (SELECT min(b) FROM (SELECT max(ts) AS b FROM fixes GROUP BY fix_id % 3))")(
    lambda f: selection.within_fields(selection.spans(f), f.groupBy(F.col("fix_id") % 3).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))).select("buoy_id")
)

query("b1_b2_append", f"""SELECT epoch_us(time) // 1000000 AS t, {r('lat', 'lon', 'u')} FROM (SELECT *, row_number() OVER (PARTITION BY time, lat, lon ORDER BY k) AS n FROM (
  SELECT *, 0 AS k FROM sampled WHERE lat < 6 UNION ALL SELECT time, lat, lon, u + 1, v, 1 FROM sampled)) WHERE n = 1""")(
    lambda s, d: field.append(*[(f := field.harmonise(views.sampled_field(views.fixes(s, d)))).where("lat < 6"), f.withColumn("u", F.col("u") + 1)], keys=("time", "lat", "lon")).select(F.unix_seconds("time").alias("t"), "lat", "lon", "u")
)
query("b3_fill_gaps", f"""SELECT epoch_us(time) // 1000000 AS t, {r('lat', 'lon', 'coalesce(u, pu + (nu - pu) * (lat - pl) / nullif(nl - pl, 0)) AS u')} FROM (SELECT *,
  last_value(u IGNORE NULLS) OVER a AS pu, last_value(CASE WHEN u IS NOT NULL THEN lat END IGNORE NULLS) OVER a AS pl,
  first_value(u IGNORE NULLS) OVER b AS nu, first_value(CASE WHEN u IS NOT NULL THEN lat END IGNORE NULLS) OVER b AS nl
  FROM (SELECT time, lat, lon, CASE WHEN (lat * 2)::INT % 3 <> 0 THEN u END AS u FROM sampled)
  WINDOW a AS (PARTITION BY time, lon ORDER BY lat ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY time, lon ORDER BY lat ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""")(
    lambda s, d: field.fill_gaps(views.sampled_field(views.fixes(s, d)).withColumn("u", F.when((F.col("lat") * 2).cast("int") % 3 != 0, F.col("u"))), "lat", ["time", "lon"], ("u",)).select(F.unix_seconds("time").alias("t"), "lat", "lon", "u")
)
query("b4_merge_products", f"SELECT {r('avg(a.u) AS u', 'avg(b.u) AS ust')}, count(*) AS n FROM sampled a JOIN sampled b USING (time, lat, lon)")(
    lambda s, d: field.merge_products(f := views.sampled_field(views.fixes(s, d)), f).agg(F.avg("u").alias("u"), F.avg("ust").alias("ust"), F.count("*").alias("n"))
)
query("b6_time_mean", f"SELECT {r('lat AS depth', 'avg(u) AS u', 'avg(v) AS v')} FROM sampled WHERE time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' GROUP BY lat")(
    lambda s, d: field.mean_by_depth(views.sampled_field(views.fixes(s, d)).withColumnRenamed("lat", "depth"), "2024-01-05", "2024-01-20")
)
query("b10_quarterly_profile", f"SELECT year(time)::INT AS year, quarter(time)::INT AS quarter, {r('lat', 'avg(u) AS u')} FROM zonal GROUP BY year(time), quarter(time), lat")(lambda s, d: field.quarterly_profile(views.sampled_field(views.fixes(s, d))))
query("b11_zero_crossing", f"""SELECT epoch_us(z.time) // 1000000 AS t, {r('min(x.at) AS lat')} FROM (SELECT DISTINCT time FROM zonal) z LEFT JOIN (SELECT time, lat + (l1 - lat) * (-u) / (u1 - u) AS at FROM
  (SELECT *, lead(u) OVER w AS u1, lead(lat) OVER w AS l1 FROM zonal WINDOW w AS (PARTITION BY time ORDER BY lat)) WHERE u < 0 AND u1 >= 0) x USING (time) GROUP BY z.time""")(
    lambda s, d: field.zero_crossing(views.sampled_field(views.fixes(s, d))).select(F.unix_seconds("time").alias("t"), "lat")
)
query("b12_spatial_variance", f"SELECT time::DATE AS day, {r('var_pop(u) + var_pop(v) AS variance')} FROM sampled GROUP BY time::DATE")(lambda s, d: field.spatial_variance(views.sampled_field(views.fixes(s, d))))
query("b13_zonal_mean", f"SELECT epoch_us(time) // 1000000 AS t, {r('lat', 'u')} FROM zonal")(lambda s, d: field.zonal_mean(views.sampled_field(views.fixes(s, d))).select(F.unix_seconds("time").alias("t"), "lat", "u"))
query("b13_zonal_scale", f"SELECT {r('quantile_cont(abs(u), 0.98) AS scale')} FROM zonal")(lambda s, d: field.zonal_scale(views.sampled_field(views.fixes(s, d))))
query("e1_field_at_fixes", f"""SELECT {KEY}, {r('(7 * (lon + 164.5) * 4 - 5 * (lat - 4.0) * 4 + 3 * t) / 256.0 AS mapped_u', '(2 * (lon + 164.5) * 4 + 3 * (lat - 4.0) * 4 - 4 * t) / 256.0 AS mapped_v')}
  FROM (SELECT *, (epoch_us(ts) / 1e6 - {views.EPOCH}) / 86400 AS t FROM fixes)""")(
    lambda s, d: field.at_points(views.fixes(s, d), views.field(s), views.GRID).select("buoy_id", "fix_id", "mapped_u", "mapped_v")
)

_U, _V = "((7 * (lon + 164.5) * 4 - 5 * (lat - 4.0) * 4 + 3 * t) / 256.0)", "((2 * (lon + 164.5) * 4 + 3 * (lat - 4.0) * 4 - 4 * t) / 256.0)"
query("e2_products_at_fixes", f"""SELECT {KEY}, {r(f'{_U} AS mapped_current_u', f'{_V} AS mapped_current_v', f'2 * {_V} AS mapped_wind_u', f'{_U} - 1 AS mapped_wind_v', f'{_U} / 4 AS mapped_waves_u', f'{_V} / 8 AS mapped_waves_v')}
  FROM (SELECT *, (epoch_us(ts) / 1e6 - {views.EPOCH}) / 86400 AS t FROM fixes)""")(
    lambda s, d: field.products_at_points(views.fixes(s, d), views.field_products(s), ["current", "wind", "waves"], views.GRID).drop("ts", "lon", "lat")
)

fq("f1_daily_starts", f"""SELECT day, buoy_id, {r('arg_min(lon, (ts, fix_id)) AS lon', 'arg_min(lat, (ts, fix_id)) AS lat')} FROM (SELECT f.*, f.ts::DATE AS day FROM fixes f JOIN spans s USING (buoy_id)
  WHERE s.entry_ts <= f.ts::DATE::TIMESTAMP AND s.exit_ts >= f.ts::DATE::TIMESTAMP AND f.ts > f.ts::DATE::TIMESTAMP) GROUP BY day, buoy_id""")(lambda f: forecast.daily_starts(f).select("day", "buoy_id", "lon", "lat"))
fq("f2_trailing_velocity", f"SELECT {KEY}, {r('avg(u) OVER w AS u_mean', 'avg(v) OVER w AS v_mean')} FROM legs WINDOW w AS (PARTITION BY buoy_id ORDER BY ts, fix_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")(
    lambda f: forecast.trailing_velocity(tracks.legs(f), 3).select("buoy_id", "fix_id", "u_mean", "v_mean")
)
fq("f3_dense_number", "SELECT fix_id, (dense_rank() OVER (ORDER BY buoy_id) - 1)::INT AS number FROM fixes")(lambda f: forecast.dense_number(f).select("fix_id", F.col("number").cast("int").alias("number")))
fq("f4_no_motion", f"SELECT buoy_id, fix_id, day, {r('lead_h', 'lat_fc', 'lon_fc')} FROM still")(lambda f: views.runs(f).select("buoy_id", "fix_id", "day", "lead_h", "lat_fc", "lon_fc"))
fq("f5_persistence", f"""SELECT s.buoy_id, s.fix_id, s.day, {r('lat_fc + vlat * lead_h * 3600 AS lat_fc', 'lon_fc + vlon * lead_h * 3600 AS lon_fc')} FROM still s JOIN
  (SELECT buoy_id, ts AS start_ts, coalesce(dx_deg / nullif(dt_s, 0), 0) AS vlon, coalesce(dy_deg / nullif(dt_s, 0), 0) AS vlat, row_number() OVER (PARTITION BY buoy_id, ts ORDER BY fix_id) AS k FROM legs) v
  ON s.buoy_id = v.buoy_id AND s.start_ts = v.start_ts AND k = 1""")(lambda f: forecast.persistence(f).select("buoy_id", "fix_id", "day", "lat_fc", "lon_fc"))
fq("f5_persistence_of_four", f"""SELECT s.buoy_id, s.fix_id, s.day, {r('lat_fc + vlat * lead_h * 3600 AS lat_fc', 'lon_fc + vlon * lead_h * 3600 AS lon_fc')} FROM still s JOIN
  (SELECT buoy_id, ts AS start_ts, coalesce((lon - first_value(lon) OVER w) / nullif(dt, 0), 0) AS vlon, coalesce((lat - first_value(lat) OVER w) / nullif(dt, 0), 0) AS vlat, row_number() OVER (PARTITION BY buoy_id, ts ORDER BY fix_id) AS k
  FROM (SELECT *, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS dt FROM fixes WINDOW w AS (PARTITION BY buoy_id ORDER BY ts, fix_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
  WINDOW w AS (PARTITION BY buoy_id ORDER BY ts, fix_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) v
  ON s.buoy_id = v.buoy_id AND s.start_ts = v.start_ts AND k = 1""")(lambda f: forecast.persistence(f, velocity_window=4).select("buoy_id", "fix_id", "day", "lat_fc", "lon_fc"))
fq("f5_base_speeds", f"""SELECT s.buoy_id, s.day, {r("arg_max({'x': speed}, (ts, fix_id)).x AS last", "quantile_cont(speed, 0.5) AS median", "avg(speed) AS mean")} FROM (SELECT DISTINCT buoy_id, day, start_ts FROM runs) s
  JOIN legs l ON l.buoy_id = s.buoy_id AND l.ts <= s.start_ts AND l.ts > s.start_ts - INTERVAL 36 HOUR GROUP BY s.buoy_id, s.day, s.start_ts""")(
    lambda f: forecast.base_speeds(tracks.legs(f), 36.0).drop("start_ts")
)
fq("f8_truncate", f"""SELECT buoy_id, fix_id FROM (SELECT *, max(CASE WHEN lon BETWEEN {B[0]} AND {B[1]} AND lat BETWEEN {B[2]} AND {B[3]} THEN 0 ELSE 1 END) OVER (PARTITION BY buoy_id ORDER BY ts) AS o,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY buoy_id)) / 3.6e9 AS age FROM fixes) WHERE o = 0 AND age <= 168""")(
    lambda f: forecast.truncate(f.withColumn("run_id", F.col("buoy_id")), B).select("buoy_id", "fix_id")
)
_OBS = "SELECT buoy_id, fix_id, epoch_us(ts) + ((fix_id * 37) % 90 - 45) * 1000000 AS us, fix_id % 1000 / 8.0::DOUBLE AS reading FROM fixes"
fq("g2_nearest_asof", f"""SELECT f.buoy_id, f.fix_id, {r('arg_min(o.reading, (abs(o.us - epoch_us(f.ts)), o.us, CASE WHEN o.us <= epoch_us(f.ts) THEN -o.fix_id ELSE o.fix_id END)) AS reading')}
  FROM fixes f LEFT JOIN ({_OBS}) o ON f.buoy_id = o.buoy_id AND abs(o.us - epoch_us(f.ts)) <= 60000000 GROUP BY f.buoy_id, f.fix_id""")(lambda f: views.matched(f).select("buoy_id", "fix_id", "reading"))
fq("g7_position_error", f"SELECT buoy_id, fix_id, day, {r('error_km')} FROM errors")(lambda f: verify.position_error(views.runs(f)).select("buoy_id", "fix_id", "day", "error_km"))
fq("g8_skill", f"""SELECT buoy_id, fix_id, day, {r('CASE WHEN far > 0 THEN greatest(0.0, 1 - e / far) END AS skill')} FROM
  (SELECT *, {hav('lat_fc', 'lon_fc', 'lat_fc + 0.1', 'lon_fc')} AS far, {hav('lat_true', 'lon_true', 'lat_fc + 0.1', 'lon_fc')} AS e FROM still)""")(
    lambda f: verify.skill_displacement(verify.position_error(verify.initial_position(views.runs(f).withColumn("lat_fc", F.col("lat_fc") + 0.1)))).select("buoy_id", "fix_id", "day", "skill")
)
fq("g9_path_skill", f"""SELECT {r('bin * 4.0 + 4 AS lead_hi', 'avg(skill) AS skill')} FROM (SELECT *, (ceil(lead_h / 4) - 1)::INT AS bin, CASE WHEN sum(st) OVER (PARTITION BY buoy_id, start_ts ORDER BY lead_h) > 0 THEN greatest(0.0, 1 - error_km / sum(st) OVER (PARTITION BY buoy_id, start_ts ORDER BY lead_h)) END AS skill FROM
  (SELECT *, 110 * sqrt(pow(lat_true - lag(lat_true) OVER w, 2) + pow(lon_true - lag(lon_true) OVER w, 2)) AS st FROM errors WINDOW w AS (PARTITION BY buoy_id, start_ts ORDER BY lead_h))) WHERE lead_h > 0 AND lead_h <= 192 GROUP BY bin UNION ALL SELECT 0.0, 0.0""")(
    lambda f: verify.mean_skill(verify.skill_path(verify.position_error(views.runs(f))))
)
fq("g10_g11_g12_by_lead", f"""SELECT b.bin::INT AS bin, coalesce(n, 0) AS n, rmse, q30, q90 FROM (SELECT unnest(range(48)) AS bin) b LEFT JOIN (SELECT bin, count(*) AS n, {r('sqrt(avg(error_km * error_km)) AS rmse', 'quantile_cont(error_km, 0.3) AS q30', 'quantile_cont(error_km, 0.9) AS q90')} FROM binned GROUP BY bin) x USING (bin)""")(
    lambda f: verify.by_lead(verify.position_error(views.runs(f))).select("bin", F.coalesce("n", F.lit(0)).alias("n"), "rmse", "q30", "q90")
)
fq("g13_rmse_at", f"SELECT {r('sqrt(avg(error_km * error_km)) AS rmse')}, count(*) AS n FROM errors WHERE lead_h > 70 AND lead_h < 74")(lambda f: verify.rmse_at(verify.position_error(views.runs(f)), 72))
fq("g14_error_by_predictor", f"""SELECT least(ceil((x - lo) / ((hi - lo) / 19)) - 1, 18)::INT AS bin, {r('avg(error_km) AS error_km')}, count(*) AS n FROM
  (SELECT lat_fc AS x, error_km, min(lat_fc) OVER () AS lo, max(lat_fc) OVER () AS hi FROM binned WHERE bin = 17) WHERE x > lo GROUP BY 1""")(lambda f: verify.error_by_predictor(verify.position_error(views.runs(f)), "lat_fc", 17))
fq("g15_share_histogram", f"""SELECT least(floor(x * 19), 18)::INT AS bin, count(*) AS n, {r('count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct')} FROM (SELECT (fix_id % 257) / 256.0::DOUBLE AS x FROM fixes) WHERE x >= 0 AND x <= 1 GROUP BY 1""")(
    lambda f: verify.share_histogram(f.withColumn("x", (F.col("fix_id") % 257) / 256.0), "x")
)
fq("g17_first_in_window", "SELECT buoy_id, day, fix_id FROM (SELECT *, row_number() OVER (PARTITION BY buoy_id, start_ts ORDER BY lead_h) AS k FROM runs WHERE lead_h > 68) WHERE k = 1 AND lead_h < 76")(
    lambda f: verify.first_in_window(forecast.leads(f), 68, 76).select("buoy_id", "day", "fix_id")
)
fq("g18_daily_error", f"""SELECT day, {r('e AS error_km', 'avg(e) OVER (ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS rolling')} FROM (SELECT day, avg(error_km) AS e FROM binned WHERE bin = 17 GROUP BY day)""")(
    lambda f: verify.daily_error(verify.position_error(views.runs(f)), 17)
)
fq("g19_daily_variance", f"""SELECT day, {r('x AS variance', 'CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w END AS rolling')} FROM (SELECT ts::DATE AS day, var_samp(u) + var_samp(v) AS x FROM legs GROUP BY ts::DATE)
  WINDOW w AS (ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)""")(lambda f: verify.daily_variance(tracks.legs(f)))
_VAR = "SELECT ts::DATE AS day, var_samp(u) + var_samp(v) AS x FROM legs GROUP BY ts::DATE"
fq("g20_lagged_correlation", f"SELECT {r('corr(e, y) AS correlation')} FROM (SELECT day, avg(error_km) AS e FROM binned WHERE bin = 17 GROUP BY day) LEFT JOIN (SELECT day, lag(x, 3) OVER (ORDER BY day) AS y FROM ({_VAR})) USING (day)")(
    lambda f: verify.lagged_correlation(verify.daily_error(verify.position_error(views.runs(f)), 17), verify.daily_variance(tracks.legs(f)), "error_km", "variance")
)


def _regressed(f: DataFrame) -> DataFrame:
    made = {"w_re": F.col("u") * 2 + (F.col("fix_id") % 13) / 8.0, "w_im": F.col("v") - (F.col("fix_id") % 7) / 4.0, "s_re": (F.col("fix_id") % 11) / 3.0, "s_im": (F.col("fix_id") % 17) / 5.0}
    return tracks.clean(f).withColumns(made)


_REG = """SELECT u AS y_re, v AS y_im, u * 2 + (fix_id % 13) / 8.0::DOUBLE AS w_re, v - (fix_id % 7) / 4.0::DOUBLE AS w_im FROM cleaned"""
_ANOM = f"SELECT y_re - avg(y_re) OVER () AS a, y_im - avg(y_im) OVER () AS b, w_re - avg(w_re) OVER () AS c, w_im - avg(w_im) OVER () AS d FROM ({_REG})"
fq("h1_h2_complex_correlation", f"""SELECT {r('sqrt(p * p + q * q) / sqrt(yy * ww) AS r', 'degrees(atan2(q, p)) AS angle', 'p / ww AS z_re', '-q / ww AS z_im')} FROM (SELECT avg(a * c + b * d) AS p, avg(a * d - b * c) AS q, avg(a * a + b * b) AS yy, avg(c * c + d * d) AS ww FROM ({_ANOM}))""")(
    lambda f: cregress.scale(cregress.correlation(cregress.gram(_regressed(f), ("u", "v"), {"w": ("w_re", "w_im")}), "w"), "w").select(F.col("r_w").alias("r"), F.col("angle_w").alias("angle"), F.col("z_w_re").alias("z_re"), F.col("z_w_im").alias("z_im"))
)
query("h3_h4_h8_least_squares")(lambda s, d: cregress.least_squares(cregress.gram(_regressed(views.fixes(s, d)), ("u", "v"), {"w": ("w_re", "w_im"), "s": ("s_re", "s_im")}), ["w", "s"]).select("n", "c_w_re", "c_w_im", "c_s_re", "c_s_im"))
query("h9_model_sweep")(lambda s, d: cregress.sweep(_regressed(views.fixes(s, d)), ("u", "v"), {"current": ("w_re", "w_im"), "wave": ("s_re", "s_im")}, {"turn": ("w_im", "s_re")}).select("model", "n", "r_x", "angle_x", "c_x_re", "c_x_im", "c_turn_re", "c_turn_im"))
fq("h11_histogram", "SELECT least(floor((lon + 164.25) / 0.5), 7)::INT AS ix, least(floor((lat - 4.25) / 0.5), 7)::INT AS iy, count(*) AS n FROM fixes WHERE lon BETWEEN -164.25 AND -160.25 AND lat BETWEEN 4.25 AND 8.25 GROUP BY 1, 2")(
    lambda f: bins.histogram2d(f, "lon", "lat", (-164.25, 0.5, 8), (4.25, 0.5, 8))
)
fq("h13_binned_field", f"SELECT floor(lon * 2)::INT AS ix, floor(lat * 2)::INT AS iy, {r('avg(dx_deg) AS dx', 'avg(dy_deg) AS dy')} FROM legs WHERE lon0 IS NOT NULL GROUP BY 1, 2")(
    lambda f: tracks.legs(f).where("lon0 is not null").groupBy(F.floor(F.col("lon") * 2).cast("int").alias("ix"), F.floor(F.col("lat") * 2).cast("int").alias("iy")).agg(F.avg("dx_deg").alias("dx"), F.avg("dy_deg").alias("dy"))
)
_DRAWN = f"((resample * 7919 + fix_id % {bootstrap.PRIME} * 104729 + 1) % {bootstrap.PRIME} * 48271 % {bootstrap.PRIME})"
_DRAWN = f"((({_DRAWN} * {_DRAWN}) % {bootstrap.PRIME} * {_DRAWN} + {_DRAWN}) % {bootstrap.PRIME})"
fq("h14_cell_bootstrap", f"""SELECT iy, {r('mean', 'p - mean AS error')} FROM (SELECT iy, quantile_cont(s / nullif(c, 0), 0.95) AS p FROM (
  SELECT iy, resample, sum(speed * times) AS s, sum(times) AS c FROM (SELECT iy, resample, speed, {" + ".join(f"(u >= {b})::INT" for b in bootstrap.POISSON)} AS times
  FROM (SELECT floor(lat)::INT AS iy, resample, speed, {_DRAWN} AS u FROM cleaned, (SELECT unnest(range(1000)) AS resample) WHERE speed IS NOT NULL)) GROUP BY ALL) GROUP BY iy)
  JOIN (SELECT floor(lat)::INT AS iy, avg(speed) AS mean FROM cleaned GROUP BY 1) USING (iy)""")(lambda f: bootstrap.cell_error(tracks.clean(f).withColumn("iy", F.floor("lat").cast("int")), ["iy"], "speed", "fix_id"))
_SEASONS = "(SELECT floor(lat * 4)::INT AS iy, quarter(t) AS season, year(t) AS y, u FROM (SELECT *, ts + to_months((fix_id % 48)::INT) AS t FROM cleaned))"
fq("h16_h17_profile", f"""SELECT iy, season, n_years, {r('p.u AS u', 'e.se AS se')} FROM (SELECT iy, season, avg(u) AS u FROM {_SEASONS} GROUP BY ALL) p JOIN
  (SELECT iy, season, stddev_samp(m) / sqrt(count(m)) AS se, count(m) AS n_years FROM (SELECT iy, season, y, avg(u) AS m FROM {_SEASONS} GROUP BY ALL) GROUP BY ALL) e USING (iy, season)""")(lambda f: _profile(f))
fq("h16_yearly_profile", f"SELECT iy, season, y AS year, {r('avg(u) AS u')} FROM {_SEASONS} GROUP BY iy, season, y")(lambda f: profile.seasonal_profile(views.over_years(tracks.clean(f)), "u", by_year=True))
fq("h18_moments", f"SELECT {r('avg(u) AS mu', 'stddev_samp(u) AS su', 'avg(v) AS mv', 'stddev_samp(v) AS sv', '(epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6 / 365.25 AS years')} FROM cleaned")(
    lambda f: tracks.clean(f).agg(F.avg("u").alias("mu"), F.stddev_samp("u").alias("su"), F.avg("v").alias("mv"), F.stddev_samp("v").alias("sv"), ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86400e6 / 365.25).alias("years"))
)
_GAPS = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY buoy_id, segment) AS n_seg FROM (SELECT *, sum(CASE WHEN dt_s > 259200 THEN 1 ELSE 0 END) OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) AS segment FROM legs)) WHERE n_seg > 1"
fq("i1_split_at_gaps", f"SELECT buoy_id, fix_id, segment::BIGINT AS segment FROM ({_GAPS})")(lambda f: spectra.split_at_gaps(f, 72).select("buoy_id", "fix_id", "segment"))
fq("i1_i5_acf_job")(lambda f: spectra.acf_job(tracks.legs(f)).select("buoy_id", "segment", "chunk_no", "lag", "r"))
fq("i4_scalar_acf")(lambda f: spectra.scalar_acf(spectra.chunks(spectra.split_at_gaps(tracks.legs(f), 72), 4, 7), ["buoy_id", "segment", "chunk_no"]))
fq("i7_i8_block_bootstrap")(lambda f: _acf_band(f))
fq("i9_i11_mean_spectrum")(lambda f: spectra.mean_spectrum(spectra.periodogram(spectra.chunks(spectra.split_at_gaps(tracks.legs(f), 72), 4, 7), ["buoy_id"], 42, 6.0), 42, 6.0))
fq("i10_welch")(lambda f: spectra.mean_spectrum(spectra.welch(spectra.chunks(spectra.split_at_gaps(tracks.legs(f), 72), 4, 7), ["buoy_id"], "u", 42, 6.0), 42, 6.0))
fq("i12_i13_coherence")(lambda f: spectra.coherence(spectra.cross_spectra(spectra.chunks(spectra.split_at_gaps(tracks.legs(f), 72), 4, 7), ["buoy_id", "start_us"], "u", "v", 42)))
fq("i14_coherence_band")(lambda f: _coherence_band(f))
fq("e3_regular_resample")(
    lambda f: resample.regular(tracks.legs(f).dropna(subset=["u", "v"]).withColumn("us", F.unix_micros("ts")), ["buoy_id"], "us", ["u", "v"], 4 * 3_600_000_000).select("buoy_id", "i", "u", "v")
)


def by_time(rows: DataFrame, days: float = 5) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with the block of their start, 1000 resamples of the blocks that hold any); the tables span about a month."""
    placed, n = bootstrap.numbered_blocks(rows, "start_us", days)
    return placed, bootstrap.draws(rows.sparkSession, 1000, n)


def _profile(f: DataFrame) -> DataFrame:
    rows = views.over_years(tracks.clean(f))
    return profile.seasonal_profile(rows, "u").join(profile.interannual_error(rows, "u"), ["iy", "season"])


def _coherence_band(f: DataFrame) -> DataFrame:
    cross, draws = by_time(spectra.cross_spectra(spectra.chunks(spectra.split_at_gaps(tracks.legs(f), 72), 4, 7), ["buoy_id", "start_us"], "u", "v", 42))
    return bootstrap.coherence_band(cross, "block", draws)


def _acf_band(f: DataFrame) -> DataFrame:
    acf, draws = by_time(spectra.acf_job(tracks.legs(f)))
    return bootstrap.over_blocks(acf, "block", ["lag"], "r", draws)
