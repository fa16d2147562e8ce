"""Registered queries on uneven grids, cells and polygons, each with the SQL of its result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import field, polygons, regrid, selection
from tidemark.plans import views
from tidemark.plans.registry import ORACLE_SQL, fq, r
from tidemark.sources import tables
from tidemark.sources.scratch import shared_folder

AXES = {"time": "ts", "depth": "depth", "lat": "lat", "lon": "lon"}
PRODUCTS = """SELECT 'current' AS product, epoch_us(time) / 1e6 + day(time) % 3 * 3600 AS t, z AS depth, lat + lat * lat / 40.0::DOUBLE AS lat, lon, u - z * v / 64.0::DOUBLE + z * z / 512.0::DOUBLE AS u, v
  FROM sampled, (SELECT unnest([0.5, 5.0, 20.0, 50.0]::DOUBLE[]) AS z)
  UNION ALL SELECT 'wind', epoch_us(time) / 1e6, 10.0, lat, lon - (lon + 160) * (lon + 160) / 32.0::DOUBLE, v * 2, u - 1 FROM sampled WHERE day(time) % 2 = 1"""


def mapped_sql(points: str, key: str) -> str:
    """SQL of regrid.at_points() for points (key, product, t, depth, lat, lon): lower and upper axis value of each, then all corners."""
    axes = ("t", "depth", "lat", "lon")
    sizes = ", ".join(f"list_sort(list(DISTINCT {a})) AS {a}_axis" for a in axes)
    placed = ", ".join(f"CASE WHEN len({a}_axis) = 1 AND {a} = {a}_axis[1] THEN [{a}, {a}] WHEN {a} = {a}_axis[-1] THEN {a}_axis[-2:] ELSE [list_max(list_filter({a}_axis, lambda x: x <= {a})), list_min(list_filter({a}_axis, lambda x: x > {a}))] END AS {a}_cell" for a in axes)
    corner = "SELECT {key}, product, depth, t, lat, lon, w, {a}_at, {rest} FROM (SELECT *, unnest([{a}_cell[1], {a}_cell[2]]) AS {a}_at, unnest([1 - f, f]) * w0 AS w FROM (SELECT * EXCLUDE (w), w AS w0, coalesce(({a} - {a}_cell[1]) / nullif({a}_cell[2] - {a}_cell[1], 0), 0) AS f FROM ({below})))"
    sql = f"SELECT *, 1.0::DOUBLE AS w FROM (SELECT p.*, {placed} FROM ({points}) p JOIN (SELECT product, {sizes} FROM products GROUP BY product) USING (product))"
    for i, a in enumerate(axes):
        rest = ", ".join([f"{b}_at" for b in axes[:i]] + [f"{b}_cell" for b in axes[i + 1 :]]) or "1 AS one"
        sql = corner.format(key=key, a=a, rest=rest, below=sql)
    on = " AND ".join(f"c.{a} = p.{a}_at" for a in axes)
    return f"""SELECT * FROM (WITH products AS ({PRODUCTS}) SELECT {key}, p.product, {r('CASE WHEN count(c.u) = 16 THEN sum(w * c.u) END AS mapped_u', 'CASE WHEN count(c.v) = 16 THEN sum(w * c.v) END AS mapped_v')}
      FROM ({sql}) p LEFT JOIN products c ON c.product = p.product AND {on} GROUP BY {key}, p.product)"""


def _points(f: DataFrame) -> DataFrame:
    """Each fix at a depth by its number, asked of both products; the wind is asked at its own depth."""
    depth = F.when(F.col("product") == "wind", 10.0).otherwise((F.col("fix_id") % 61).cast("double"))
    return f.withColumn("product", F.explode(F.array(F.lit("current"), F.lit("wind")))).withColumn("depth", depth)


_FIXES = "SELECT buoy_id, fix_id, product, epoch_us(ts) / 1e6 AS t, CASE WHEN product = 'wind' THEN 10.0 ELSE (fix_id % 61)::DOUBLE END AS depth, lat, lon FROM fixes, (SELECT unnest(['current', 'wind']) AS product)"
fq("e1_uneven_axes_at_fixes", mapped_sql(_FIXES, "buoy_id, fix_id"))(
    lambda f: regrid.at_points(_points(f), views.uneven_products(f), AXES, ["product"]).select("buoy_id", "fix_id", "product", "mapped_u", "mapped_v")
)

_WIND_ON_CURRENT = "SELECT DISTINCT t::BIGINT AS s, depth AS z, floor(lat * 1e6 + 0.5) / 1e6 AS y, lon AS x, 'wind' AS product, t, 10.0::DOUBLE AS depth, lat, lon FROM products WHERE product = 'current'"


def _wind_on_current(f: DataFrame) -> DataFrame:
    """The wind at every node of the current."""
    both = views.uneven_products(f)
    nodes = both.where("product = 'current'").select(F.unix_seconds("time").alias("s"), F.col("depth").alias("z"), F.col("lat").alias("y"), F.col("lon").alias("x"), F.lit("wind").alias("product"), "time", F.lit(10.0).alias("depth"), "lat", "lon")
    return regrid.at_points(nodes, both, {**AXES, "time": "time"}, ["product"]).select("s", "z", "y", "x", "product", "mapped_u", "mapped_v")


fq("b7_wind_on_currents_axes", mapped_sql(_WIND_ON_CURRENT, "s, z, y, x"))(_wind_on_current)

# -- many polygons: a four-pointed star about every fiftieth fix
STAR = [(1.0, 0.0), (0.25, 0.3125), (0.0, 1.5), (-0.25, 0.25), (-1.0, 0.125), (-0.3125, -0.25), (0.0, -1.25), (0.25, -0.25)]


def _stars(f: DataFrame) -> DataFrame:
    """(poly_id, ring) of stars of 1/32 to 7/32 of a degree."""
    size = (F.col("fix_id") % 7 + 1) / 32.0
    return f.where("fix_id % 50 = 3").select(F.col("fix_id").alias("poly_id"), F.array(*[F.struct((F.col("lon") + x * size).alias("lon"), (F.col("lat") + y * size).alias("lat")) for x, y in STAR]).alias("ring"))


_SIDES = ", ".join(f"({a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for a, b in zip(STAR, [*STAR[1:], STAR[0]], strict=True))
_STAR_SIDES = f"""SELECT fix_id AS poly_id, lon + a * z AS x0, lat + b * z AS y0, lon + c * z AS x1, lat + d * z AS y1 FROM (SELECT *, (fix_id % 7 + 1) / 32.0::DOUBLE AS z FROM fixes WHERE fix_id % 50 = 3), (VALUES {_SIDES}) t(a, b, c, d)"""
_IN_STARS = f"""SELECT poly_id, buoy_id, fix_id, ts FROM fixes f, ({_STAR_SIDES}) s WHERE (y0 > lat) <> (y1 > lat) AND lon < (x1 - x0) * (lat - y0) / (y1 - y0) + x0 GROUP BY ALL HAVING count(*) % 2 = 1"""
fq("c6_in_many_polygons", f"SELECT poly_id, fix_id FROM ({_IN_STARS})")(lambda f: polygons.in_polygons(f, _stars(f), columns=["fix_id"]).select("poly_id", "fix_id"))
fq("c6_runs_in_many_polygons", f"""SELECT poly_id, buoy_id, fix_id, run, run_len FROM (SELECT *, count(*) OVER (PARTITION BY poly_id, buoy_id, run) AS run_len FROM (
  SELECT *, first_value(fix_id) OVER (PARTITION BY poly_id, buoy_id, island ORDER BY ts, fix_id) AS run FROM (
  SELECT i.*, n - row_number() OVER (PARTITION BY poly_id, buoy_id ORDER BY n) AS island FROM ({_IN_STARS}) i JOIN (SELECT fix_id, row_number() OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) AS n FROM fixes) USING (fix_id)))) WHERE run_len >= 2""")(
    lambda f: polygons.runs_in_polygons(f, _stars(f), columns=["buoy_id", "fix_id"]).select("poly_id", "buoy_id", "fix_id", "run", "run_len")
)
fq("d6_active_with_reentry", """SELECT day::DATE AS day, count(buoy_id) AS active FROM (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM fixes), (SELECT max(ts)::DATE FROM fixes), INTERVAL 1 DAY))::DATE AS day)
  LEFT JOIN (SELECT buoy_id, span, min(d) AS a, max(d) AS b FROM (SELECT *, sum(CASE WHEN d - before >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY buoy_id ORDER BY d) AS span FROM
  (SELECT *, lag(d) OVER (PARTITION BY buoy_id ORDER BY d) AS before FROM (SELECT DISTINCT buoy_id, ts::DATE AS d FROM fixes))) GROUP BY ALL) ON day BETWEEN a AND b GROUP BY day""")(selection.active_with_reentry)

# -- tables that are kept, written in the shared folder and read again
def _appended(f: DataFrame) -> DataFrame:
    """Cells south of 6 degrees, then all cells with other values added: old ones win (B2, A10)."""
    path = f"{shared_folder(f.sparkSession)}/cells-{uuid.uuid4().hex[:12]}"
    cells = views.sampled_field(f).select(F.to_date("time").cast("string").alias("day"), F.unix_seconds("time").alias("t"), "lat", "lon", "u")
    tables.append_new(cells.where("lat < 6"), path, ["t", "lat", "lon"], "day")
    tables.append_new(cells.withColumn("u", F.col("u") + 1), path, ["t", "lat", "lon"], "day")
    return f.sparkSession.read.schema(cells.schema).parquet(path).select("t", "lat", "lon", "u")


fq("b2_append_to_table")(_appended)
ORACLE_SQL["b2_append_to_table"] = ORACLE_SQL["b1_b2_append"]


def _from_file(f: DataFrame) -> DataFrame:
    """Tracks written with their lines and read again within a box."""
    path = f"{shared_folder(f.sparkSession)}/tracks-{uuid.uuid4().hex[:12]}"
    tables.write_tracks(f, path)
    return tables.read_tracks(f.sparkSession, path, (-163.0, -161.5, 5.0, 6.5)).select("buoy_id", "fix_id", "lon", "lat")


fq("a8_tracks_in_a_box", f"SELECT buoy_id, fix_id, {r('lon', 'lat')} FROM (SELECT *, count(*) OVER (PARTITION BY buoy_id) AS n FROM fixes) WHERE n > 1 AND lon BETWEEN -163.0 AND -161.5 AND lat BETWEEN 5.0 AND 6.5")(_from_file)

# -- the current at the depth nearest to 30 m plus a drift brought to its nodes
_DRIFT = mapped_sql(_WIND_ON_CURRENT, "s, z, y, x")


def _with_drift(f: DataFrame) -> DataFrame:
    """Mean over space and time of current and drift at one depth, where both are known."""
    return field.mean_with_drift(views.uneven_products(f).where("product = 'current'"), views.uneven_products(f).where("product = 'wind'").drop("depth"), 30.0)


fq("b6_current_and_drift", f"""SELECT 20.0::DOUBLE AS depth, count(*) AS n, {r('avg(c.u + d.mapped_u) AS u', 'avg(c.v + d.mapped_v) AS v')} FROM (SELECT * FROM ({PRODUCTS}) WHERE product = 'current' AND depth = 20) c
  JOIN ({_DRIFT}) d ON c.t = d.s AND d.z = 20 AND floor(c.lat * 1e6 + 0.5) / 1e6 = d.y AND c.lon = d.x WHERE mapped_u IS NOT NULL AND c.u IS NOT NULL HAVING count(*) > 0""")(_with_drift)
