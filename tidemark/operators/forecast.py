"""Forecast tables: starts, simple forecasts, alignment and truncation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import in_box
from tidemark.operators.asof import around
from tidemark.operators.scan import over_track
from tidemark.operators.tracks import seconds


def trailing_velocity(legs: DataFrame, k: int, most_rows: int | None = None) -> DataFrame:
    """Mean velocity of a track's last k fixes (F2)."""
    return over_track(legs, lambda w: {f"{c}_mean": F.avg(c).over(w.rowsBetween(-(k - 1), 0)) for c in ("u", "v")}, k - 1, 0, most_rows)


def daily_starts(fixes: DataFrame, legacy_dedupe: bool = False) -> DataFrame:
    """(day, buoy_id, ts, lon, lat): the earliest fix of each buoy in each day it is active, midnight excluded (F1).

    ``legacy_dedupe`` first leaves one fix for each latitude, then for each longitude, of a day, whatever the buoy.
    """
    own = Window.partitionBy("buoy_id")
    rows = fixes.withColumns({"day": F.to_date("ts"), "_entry": F.min("ts").over(own), "_exit": F.max("ts").over(own)})
    midnight = F.col("day").cast("timestamp")
    rows = rows.where((F.col("_entry").cast("timestamp") <= midnight) & (F.col("_exit").cast("timestamp") >= midnight) & (F.col("ts").cast("timestamp") > midnight))
    if legacy_dedupe:
        for c in ("lat", "lon"):
            rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("day", c).orderBy("ts", "fix_id"))).where("_r = 1").drop("_r")
    key = F.struct("ts", "fix_id")
    first = rows.groupBy("day", "buoy_id").agg(F.min("ts").alias("ts"), *[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in ("lon", "lat")])
    return first


def dense_number(rows: DataFrame, name: str = "buoy_id", ranges: int = 200) -> DataFrame:
    """Rows with the 0-based rank of their name among the distinct names.

    Names are numbered within ranges, whose bounds are ``ranges`` - 1 names (any will do, so few are read), and a range
    adds the names of those before it; rows without a name go.
    """
    names = rows.select(name).where(F.col(name).isNotNull()).distinct()
    bounds = [r[0] for r in names.orderBy(F.xxhash64(name)).limit(ranges - 1).collect()]
    place = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(name))) if bounds else F.lit(0)
    placed = names.withColumn("_range", place)
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")  # at most ``ranges`` rows
    own = F.row_number().over(Window.partitionBy("_range").orderBy(name)) - 1
    numbers = placed.withColumn("_own", own).join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return rows.join(numbers.select(name, (F.col("_own") + F.col("_before")).alias("number")), name)


def leads(fixes: DataFrame, days: int = 8) -> DataFrame:
    """(buoy_id, start_ts, day, ts, lead_h, lat_true, lon_true): a run from each buoy's first fix of each day.

    A run's fixes reach to ``days`` days after its day's start; days meet runs by equality, so nothing is compared
    with all starts.
    """
    day = F.to_date("ts")
    runs = fixes.groupBy("buoy_id", day.alias("day")).agg(F.min("ts").alias("start_ts"))
    runs = runs.withColumn("_d", F.explode(F.sequence("day", F.date_add("day", days))))
    joined = fixes.withColumn("_d", day).join(runs, ["buoy_id", "_d"])
    end = F.date_add("day", days).cast("timestamp")
    joined = joined.where((F.col("ts") >= F.col("start_ts")) & (F.col("ts").cast("timestamp") <= end))
    lead = seconds(F.col("ts")) - seconds(F.col("start_ts"))
    return joined.select("buoy_id", "start_ts", "day", "ts", "fix_id", (lead / 3600).alias("lead_h"), F.col("lat").alias("lat_true"), F.col("lon").alias("lon_true"))


def no_motion(runs: DataFrame) -> DataFrame:
    """Forecast positions that stay where the run's first truth was."""
    own = Window.partitionBy("buoy_id", "start_ts")
    first = F.min_by(F.struct("lat_true", "lon_true"), F.struct("lead_h", "fix_id")).over(own)
    return runs.withColumn("_f", first).withColumns({"lat_fc": F.col("_f.lat_true"), "lon_fc": F.col("_f.lon_true")}).drop("_f")


def persistence(fixes: DataFrame, days: int = 8, velocity_window: int = 2) -> DataFrame:
    """Forecast positions that go on at the velocity between the first and last of the ``velocity_window`` fixes up
    to the start, or of as many as there are, in degrees (F5)."""
    w = Window.partitionBy("buoy_id").orderBy("ts", "fix_id").rowsBetween(-(velocity_window - 1), 0)
    dt = seconds(F.col("ts")) - F.first(seconds(F.col("ts"))).over(w)
    moved = fixes.select("buoy_id", "ts", "fix_id", *[F.coalesce(F.try_divide(F.col(c) - F.first(c).over(w), F.nullif(dt, F.lit(0.0))), F.lit(0.0)).alias(f"d{c}") for c in ("lon", "lat")])
    first = moved.groupBy("buoy_id", "ts").agg(F.min_by(F.struct("dlon", "dlat"), "fix_id").alias("v"))
    speeds = first.select("buoy_id", F.col("ts").alias("start_ts"), F.col("v.dlon").alias("vlon"), F.col("v.dlat").alias("vlat"))
    runs = no_motion(leads(fixes, days)).join(speeds, ["buoy_id", "start_ts"])
    s = F.col("lead_h") * 3600
    return runs.withColumns({"lat_fc": F.col("lat_fc") + F.col("vlat") * s, "lon_fc": F.col("lon_fc") + F.col("vlon") * s}).drop("vlon", "vlat")


def base_speeds(legs: DataFrame, window_h: float = 6.0) -> DataFrame:
    """(buoy_id, day, start_ts, last, median, mean): speeds that persist from a run's start.

    They are those of the fixes in (start - ``window_h``, start]; without a window, of the fix at the start. Starts meet
    fixes by buoy and day, so nothing is compared with a whole track. Null speeds count in ``last`` alone.
    """
    starts = legs.groupBy("buoy_id", F.to_date("ts").alias("day")).agg(F.min("ts").alias("start_ts"))
    ago = seconds(F.col("start_ts")) - window_h * 3600
    starts = starts.withColumn("_d", F.explode(F.sequence(F.to_date(F.timestamp_seconds(F.floor(ago))), F.col("day"))))
    met = legs.select("buoy_id", F.to_date("ts").alias("_d"), "ts", "fix_id", "speed").join(starts, ["buoy_id", "_d"])
    at = seconds(F.col("ts"))
    met = met.where((F.col("ts") <= F.col("start_ts")) & ((at > ago) | (F.col("ts") == F.col("start_ts"))))
    last = F.max_by("speed", F.struct("ts", "fix_id"))
    return met.groupBy("buoy_id", "day", "start_ts").agg(last.alias("last"), F.percentile("speed", 0.5).alias("median"), F.avg("speed").alias("mean"))


def align(truth: DataFrame, track: DataFrame) -> DataFrame:
    """Truth fixes of a run with the forecast track's position interpolated to them.

    Fixes strictly inside the forecast's span count, and the one just before, whose forecast is null; lead is hours since
    the first fix kept.
    """
    both = around(truth, track.withColumnsRenamed({"lon": "lon_fc", "lat": "lat_fc"}), ["run_id"], "ts", "ts", ["lon_fc", "lat_fc"])
    w = Window.partitionBy("run_id").orderBy("ts", "fix_id")
    kept = both.withColumn("_next", F.lead("inside").over(w)).where(F.col("inside") | (F.coalesce(F.col("_next"), F.lit(False)) & ~F.col("inside")))
    first = F.min(seconds(F.col("ts"))).over(Window.partitionBy("run_id"))
    return kept.withColumn("lead_h", (seconds(F.col("ts")) - first) / 3600).drop("_next", "inside")


def damped_persistence(steps: DataFrame, step_s: float, tau_h: float = 0.83 * 24) -> DataFrame:
    """Positions of runs (run_id, step, u0, v0, u, v, lon0, lat0) that fade from a first velocity to the field's.

    The weight of the first velocity is exp(-age/tau), 0 beyond four tau; metres become degrees by 111 km on both axes.
    """
    age = F.col("step") * step_s / 3600
    p = F.when(age <= 4 * tau_h, F.exp(-age / tau_h)).otherwise(0.0)
    metres = 1 / (1000 * 111.0)
    w = Window.partitionBy("run_id").orderBy("step")
    out = steps.withColumns({"du": (p * F.col("u0") + (1 - p) * F.col("u")) * step_s * metres, "dv": (p * F.col("v0") + (1 - p) * F.col("v")) * step_s * metres})
    return out.withColumns({"lon": F.col("lon0") + F.sum("du").over(w), "lat": F.col("lat0") + F.sum("dv").over(w)})


def truncate(track: DataFrame, box: tuple, most_hours: float = 168.0) -> DataFrame:
    """Forecast samples before the first one outside the box, and up to an age (F8)."""
    w = Window.partitionBy("run_id").orderBy("ts")
    out = (~in_box(F.col("lon"), F.col("lat"), box, strict=False)).cast("int")
    age = (seconds(F.col("ts")) - F.min(seconds(F.col("ts"))).over(Window.partitionBy("run_id"))) / 3600
    return track.withColumns({"_out": F.max(out).over(w), "age_h": age}).where((F.col("_out") == 0) & (F.col("age_h") <= most_hours)).drop("_out")

