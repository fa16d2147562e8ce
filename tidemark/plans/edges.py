"""Queries on rows that the plain views lack: missing times, unique names, missing cells, products that differ. With SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import field, selection, tracks
from tidemark.plans import views
from tidemark.plans.registry import fq, r

_MISSING = "CASE WHEN buoy_id % 3 = 0 AND fix_id % 5 = 0 THEN NULL ELSE ts END"
fq("c18_tracks_with_all_times", f"SELECT buoy_id, fix_id FROM fixes WHERE buoy_id NOT IN (SELECT buoy_id FROM fixes WHERE {_MISSING} IS NULL)")(
    lambda f: tracks.with_times(f.withColumn("ts", F.when((F.col("buoy_id") % 3 > 0) | (F.col("fix_id") % 5 > 0), F.col("ts")))).select("buoy_id", "fix_id")
)
_NAME = "CASE WHEN fix_id % 4 = 0 THEN fix_id + 100000 ELSE fix_id * fix_id % 1009 END"
fq("c20_names_of_several", f"SELECT name, fix_id FROM (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM (SELECT fix_id, {_NAME} AS name FROM fixes)) WHERE n > 1")(
    lambda f: tracks.repeated_names(f.select("fix_id", F.when(F.col("fix_id") % 4 == 0, F.col("fix_id") + 100000).otherwise(F.col("fix_id") * F.col("fix_id") % 1009).alias("name")), "name").select("name", "fix_id")
)
fq("c19_quality_of_mapped", f"""SELECT count(*) AS legs, {r('count(*) FILTER (speed > 2) * 100.0::DOUBLE / count(*) AS fast_pct', 'count(*) FILTER (speed < 0.0001) * 100.0::DOUBLE / count(*) AS slow_pct')}, count(*) FILTER (NOT ok_speed) AS removed_speed,
  count(*) FILTER (NOT ok_time) AS removed_time, count(*) FILTER (speed IS NULL) AS no_speed, {r('max(speed) AS max_speed')}, count(*) FILTER (fix_id % 11 = 0) AS no_mapped_u, count(*) FILTER (fix_id % 17 < 3) AS no_mapped_v FROM masked WHERE lon0 IS NOT NULL""")(
    lambda f: tracks.quality_report(f.withColumns({"mapped_u": F.when(F.col("fix_id") % 11 > 0, 1.0), "mapped_v": F.when(F.col("fix_id") % 17 >= 3, 1.0)}), ["mapped_u", "mapped_v"])
)
fq("d5_track_by_number", f"SELECT epoch_us(ts) AS us, {r('lat AS lat_true', 'lon AS lon_true')} FROM fixes WHERE buoy_id = 7")(
    lambda f: selection.one_track(f, 7).select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "lat_true", "lon_true")
)


def _waves(f: DataFrame) -> DataFrame:
    """A drift on part of the field's nodes."""
    return views.sampled_field(f).where("day(time) % 3 > 0 and lat > 4.5").select("time", "lat", "lon", (F.col("v") * 2).alias("u"), (F.col("u") - F.col("lat")).alias("v"))


fq("b4_winds_with_waves", f"SELECT epoch_us(time) // 1000000 AS t, {r('lat', 'lon', 'u', 'v', 'v * 2 AS ust', 'u - lat AS vst')} FROM sampled WHERE day(time) % 3 > 0 AND lat > 4.5")(
    lambda f: field.merge_products(views.sampled_field(f), _waves(f)).select(F.unix_seconds("time").alias("t"), "lat", "lon", "u", "v", "ust", "vst")
)
fq("b12r_variance_of_runs", f"SELECT buoy_id, day::VARCHAR AS start_day, fix_id, {r('variance')} FROM runs LEFT JOIN (SELECT time::DATE AS day, var_pop(u) + var_pop(v) AS variance FROM sampled WHERE day(time) % 4 > 0 GROUP BY 1) USING (day)")(
    lambda f: field.variance_at_starts(views.sampled_field(f).where("day(time) % 4 > 0"), views.runs(f)).select("buoy_id", F.col("day").cast("string").alias("start_day"), "fix_id", "variance")
)


def _deep(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of the first 20 days at the surface, and of all days at two depths with a third of their values missing."""
    cells = views.sampled_field(f)

    def known(c: str) -> Column:
        return F.when((F.col("lat") * 2 + F.col("lon") * 2 + F.day("time")) % 3 != 0, F.col(c) + F.col("depth"))

    old = cells.where("day(time) <= 20").select("time", F.lit(0.5).alias("depth"), "lat", "lon", "u", "v")
    new = cells.withColumn("depth", F.explode(F.array(F.lit(15.0), F.lit(40.0)))).withColumns({"u": known("u"), "v": known("v")})
    return old, new.select("time", "depth", "lat", "lon", "u", "v")


def _filled(rows: str, axis: str, others: str) -> str:
    """SQL of field.fill_gaps() for u and v."""
    known = [f"last_value(CASE WHEN {c} IS NOT NULL THEN {{'x': {axis}, 'y': {c}}} END IGNORE NULLS) OVER a AS p{c}, first_value(CASE WHEN {c} IS NOT NULL THEN {{'x': {axis}, 'y': {c}}} END IGNORE NULLS) OVER b AS n{c}" for c in "uv"]
    mixed = [f"coalesce({c}, p{c}.y + (n{c}.y - p{c}.y) * ({axis} - p{c}.x) / nullif(n{c}.x - p{c}.x, 0)) AS {c}" for c in "uv"]
    return f"""SELECT time, depth, lat, lon, {', '.join(mixed)} FROM (SELECT *, {', '.join(known)} FROM ({rows}) WINDOW a AS (PARTITION BY {others} ORDER BY {axis} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY {others} ORDER BY {axis} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


_CELLS = """SELECT time, 0.5::DOUBLE AS depth, lat, lon, u, v FROM sampled WHERE day(time) <= 20 UNION ALL
  SELECT time, z, lat, lon, CASE WHEN fmod(lat * 2 + lon * 2 + day(time), 3) <> 0 THEN u + z END, CASE WHEN fmod(lat * 2 + lon * 2 + day(time), 3) <> 0 THEN v + z END FROM sampled, (SELECT unnest([15.0, 40.0]::DOUBLE[]) AS z)
  WHERE time BETWEEN (SELECT min(time) FROM sampled WHERE day(time) <= 20) AND (SELECT max(time) FROM sampled WHERE day(time) <= 20)"""
fq("b3_added_depths", f"SELECT epoch_us(time) // 1000000 AS t, depth, {r('lat', 'lon', 'u', 'v')} FROM ({_filled(_filled(_CELLS, 'lat', 'time, depth, lon'), 'lon', 'time, depth, lat')})")(
    lambda f: field.add_depths(*_deep(f)).select(F.unix_seconds("time").alias("t"), "depth", "lat", "lon", "u", "v")
)
