"""The tables that the registered queries work on, derived from the driver's ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.asof import nearest
from tidemark.operators.forecast import leads, no_motion

#: 2024-01-01 00:00:00 UTC in seconds, the start of the events.
EPOCH = 1704067200
BOX = (-163.75, -160.6667, 4.5, 7.75)
SITE = (-162.1, 5.9)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of events' users: whole-number arithmetic and one division, so that SQL gives the same doubles."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    s = F.floor(F.unix_micros("ts") / 1_000_000).cast("long") - EPOCH
    lon = -164.2 + F.abs((s + F.col("user_id") * 86413) % 3456000 - 1728000) / 432000.0 + ((F.col("event_id") * 7919) % 101 - 50) / 5000.0
    lat = 4.4 + F.abs((s + F.col("user_id") * 50021) % 2592000 - 1296000) / 370000.0 + ((F.col("event_id") * 104729) % 97 - 48) / 5000.0
    return e.select(F.col("user_id").alias("buoy_id"), F.col("event_id").alias("fix_id"), "ts", lon.alias("lon"), lat.alias("lat"))


def velocity(lon, lat, t):
    """A model current at a place and time (days), linear in each, so that interpolation has a closed form."""
    return (7 * lon - 5 * lat + 3 * t) / 64.0, (2 * lon + 3 * lat - 4 * t) / 64.0


def field(spark: SparkSession, days: int = 32, step: float = 0.25) -> DataFrame:
    """A gridded current over the fixes' region: (time, lat, lon, u, v), daily and every quarter degree."""
    axis = spark.range(days).select(F.col("id").alias("it"))
    rows = axis.join(F.broadcast(spark.range(18).select(F.col("id").alias("iy")))).join(F.broadcast(spark.range(19).select(F.col("id").alias("ix"))))
    u, v = (7 * F.col("ix") - 5 * F.col("iy") + 3 * F.col("it")) / 256.0, (2 * F.col("ix") + 3 * F.col("iy") - 4 * F.col("it")) / 256.0
    return rows.select(F.timestamp_seconds(F.lit(EPOCH) + F.col("it") * 86400).alias("time"), (4.0 + F.col("iy") * step).alias("lat"), (-164.5 + F.col("ix") * step).alias("lon"), u.alias("u"), v.alias("v"))


GRID = {"time": (float(EPOCH), 86400.0, 32), "lat": (4.0, 0.25, 18), "lon": (-164.5, 0.25, 19)}


def field_products(spark: SparkSession) -> DataFrame:
    """A current, a wind and a wave drift on one grid, in rows (product, time, lat, lon, u, v)."""
    kinds = {"current": (F.col("u"), F.col("v")), "wind": (F.col("v") * 2, F.col("u") - 1), "waves": (F.col("u") / 4, F.col("v") / 8)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("product"), u.alias("u"), v.alias("v")) for k, (u, v) in kinds.items()]))
    return field(spark).select("time", "lat", "lon", each.alias("p")).select("p.product", "time", "lat", "lon", "p.u", "p.v")


def over_years(fx: DataFrame) -> DataFrame:
    """The fixes dealt over 48 months by their number, for what is computed by season and year."""
    return fx.withColumn("ts", F.expr("ts + make_interval(0, cast(fix_id % 48 as int))"))


def sampled_field(fx: DataFrame) -> DataFrame:
    """A current on a daily grid of half degrees, from the fixes in each cell; grows with them."""
    cell = fx.select(F.to_timestamp(F.to_date("ts")).alias("time"), (F.floor(F.col("lat") * 2) / 2).alias("lat"), (F.floor(F.col("lon") * 2) / 2).alias("lon"), "fix_id")
    u, v = (F.col("fix_id") % 101 - 50) / 64.0, (F.col("fix_id") % 89 - 44) / 64.0
    return cell.groupBy("time", "lat", "lon").agg(F.avg(u).alias("u"), F.avg(v).alias("v"))


def uneven_products(fx: DataFrame) -> DataFrame:
    """Two products (product, time, depth, lat, lon, u, v) of the fixes' cells, each on uneven axes of its own, some nodes absent.

    The current has times at 0 to 2 h of the day, stretched latitudes and four depths over which it is curved; the wind has
    every other day, no depth but 10, and stretched longitudes.
    """
    cells = sampled_field(fx)
    depth = F.explode(F.array(*[F.lit(z) for z in (0.5, 5.0, 20.0, 50.0)]))
    current = cells.select(F.lit("current").alias("product"), F.timestamp_seconds(F.unix_seconds("time") + F.day("time") % 3 * 3600).alias("time"), depth.alias("depth"), (F.col("lat") + F.col("lat") * F.col("lat") / 40.0).alias("lat"), "lon", "u", "v")
    current = current.withColumn("u", F.col("u") - F.col("depth") * F.col("v") / 64.0 + F.col("depth") * F.col("depth") / 512.0)
    wind = cells.where("day(time) % 2 = 1").select(F.lit("wind").alias("product"), "time", F.lit(10.0).alias("depth"), "lat", (F.col("lon") - (F.col("lon") + 160) * (F.col("lon") + 160) / 32.0).alias("lon"), (F.col("v") * 2).alias("u"), (F.col("u") - 1).alias("v"))
    return current.unionByName(wind)


def runs(fx: DataFrame) -> DataFrame:
    """No-motion forecasts of a run from each buoy's first fix of each day."""
    return no_motion(leads(fx))


def observed(fx: DataFrame) -> DataFrame:
    """A second reading of each fix, 0 to 44 s off, for as-of joins."""
    off = (F.col("fix_id") * 37) % 90 - 45
    return fx.select("buoy_id", "fix_id", F.timestamp_micros(F.unix_micros("ts") + off * 1_000_000).alias("seen_ts"), (F.col("fix_id") % 1000 / 8.0).alias("reading"))


def matched(fx: DataFrame) -> DataFrame:
    return nearest(fx, observed(fx), ["buoy_id"], "ts", "seen_ts", ["reading"], 60)
