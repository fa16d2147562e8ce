"""Building and cleaning tracks. The canonical table is long: a row (buoy_id, ts, lon, lat, ...) for each fix.

Windows over a track share one specification, so a chain of these operators shuffles and sorts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.geo import displacement_km, haversine_km, in_box, in_polygon, nearest_on_leg, on_polygon
from tidemark.operators.scan import over_track

FASTEST, SLOWEST = 2.0, 0.001


def track(buoy: str = "buoy_id", ts: str = "ts", tie: str = "fix_id") -> WindowSpec:
    """A track's fixes in time order, ties by a unique key."""
    return Window.partitionBy(buoy).orderBy(ts, tie)


def micros(ts: Column) -> Column:
    """Whole microseconds, whose differences are exact."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def entry_exit(fixes: DataFrame) -> DataFrame:
    """First and last time of each track on all its fixes."""
    own = Window.partitionBy("buoy_id")
    return fixes.withColumns({"entry_ts": F.min("ts").over(own), "exit_ts": F.max("ts").over(own)})


def with_position(fixes: DataFrame) -> DataFrame:
    """Fixes that have a latitude."""
    return fixes.dropna(subset=["lat"])


def exact_dedupe(fixes: DataFrame) -> DataFrame:
    """One of rows equal in all columns."""
    return fixes.dropDuplicates()


def build_tracks(fixes: DataFrame) -> DataFrame:
    """(buoy_id, entry_ts, exit_ts, n, pts): arrays of fixes in time order; tracks of one fix are left out (C4)."""
    pts = F.array_sort(F.collect_list(F.struct("ts", "fix_id", "lon", "lat")))
    made = fixes.groupBy("buoy_id").agg(F.min("ts").alias("entry_ts"), F.max("ts").alias("exit_ts"), F.count("*").alias("n"), pts.alias("pts"))
    return made.where("n > 1")


def explode_tracks(tracks: DataFrame, drop_last: bool = False) -> DataFrame:
    """Back to a row for each fix; ``drop_last`` leaves each track's last point out."""
    pts = F.expr("slice(pts, 1, size(pts) - 1)") if drop_last else F.col("pts")
    return tracks.select("buoy_id", F.inline(pts))


def domain_runs(fixes: DataFrame, box: tuple | None = None, polygon: list | None = None, least: int = 2) -> DataFrame:
    """Fixes inside a domain (its boundary is outside), with the number of their run; shorter runs go."""
    at = (F.col("lon"), F.col("lat"))
    # the even-odd rule alone counts a left or lower edge in
    inside = in_box(*at, box) if box else in_polygon(*at, polygon) & ~on_polygon(*at, polygon)
    marked = fixes.withColumn("inside", F.coalesce(inside, F.lit(False)))
    start = (F.col("inside") & ~F.coalesce(F.lag("inside").over(track()), F.lit(False))).cast("int")
    marked = marked.withColumn("run", F.sum(start).over(track())).where("inside")
    size = F.count("*").over(Window.partitionBy("buoy_id", "run"))
    return marked.withColumn("run_len", size).where(F.col("run_len") >= least).drop("inside")


def touching_domain(fixes: DataFrame, **domain) -> DataFrame:
    """Whole tracks that have a valid run in the domain."""
    return fixes.join(domain_runs(fixes, **domain).select("buoy_id").distinct(), "buoy_id", "left_semi")


def legs(fixes: DataFrame, legacy_axis_order: bool = False, most_rows: int | None = None) -> DataFrame:
    """Fixes with the leg that ends on them: differences, kilometres, seconds, speeds in m/s.

    A track's first fix has nulls; a leg of no duration has null speeds. Tracks of over ``most_rows`` fixes are cut
    into ranges of time (scan.over_track).
    """
    out = over_track(fixes, lambda w: {"lon0": F.lag("lon").over(w), "lat0": F.lag("lat").over(w), "_us0": F.lag(micros(F.col("ts"))).over(w)}, before=1, most_rows=most_rows)
    east, north = displacement_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"), legacy_axis_order)
    whole = haversine_km(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    out = out.withColumns({"dx_deg": F.col("lon") - F.col("lon0"), "dy_deg": F.col("lat") - F.col("lat0"), "x_km": east, "y_km": north, "xy_km": whole, "dt_s": (micros(F.col("ts")) - F.col("_us0")) / 1e6})
    per = {n: F.try_divide(F.col(k) * 1000, F.col("dt_s")) for n, k in (("u", "x_km"), ("v", "y_km"), ("speed", "xy_km"))}
    return out.withColumns(per).drop("_us0")


def sampling_rate(fixes: DataFrame) -> DataFrame:
    """(buoy_id, n, days, rate_h): hours for each point (C11)."""
    span = F.max(seconds(F.col("ts"))) - F.min(seconds(F.col("ts")))
    made = fixes.groupBy("buoy_id").agg(F.min("ts").alias("start_ts"), F.count("*").alias("n"), (span / 86400).alias("days"))
    return made.withColumn("rate_h", F.col("days") / F.col("n") * 24)


def synthetic_times(fixes: DataFrame) -> DataFrame:
    """Fixes with the time that an even sampling from the start gives them (C11)."""
    rate = sampling_rate(fixes).select("buoy_id", "start_ts", "rate_h")
    number = F.row_number().over(track()) - 1
    made = fixes.withColumn("i", number).join(rate, "buoy_id")
    micros = F.unix_micros(F.col("start_ts").cast("timestamp")) + F.round(F.col("i") * F.col("rate_h") * 3.6e9).cast("long")
    return made.withColumn("even_ts", F.timestamp_micros(micros)).drop("start_ts")


def sampled_speed(fixes: DataFrame) -> DataFrame:
    """Leg speed in m/s from kilometres and the even sampling interval."""
    rate = sampling_rate(fixes).select("buoy_id", "rate_h")
    return legs(fixes).join(rate, "buoy_id").withColumn("sampled_speed", F.try_divide(F.col("xy_km"), F.col("rate_h")) / 3.6)


def speed_mask(speed: Column, slow: float = SLOWEST, fast: float = FASTEST) -> Column:
    """Plausible speeds; an unknown one passes."""
    return F.coalesce(~((speed > fast) | (speed < slow)), F.lit(True))


def duration_mask(dt: Column) -> Column:
    """Legs that last (C14)."""
    return F.coalesce(dt != 0, F.lit(True))


def masked(fixes: DataFrame) -> DataFrame:
    """Legs with their masks and the numbers of removed points of their track."""
    own = Window.partitionBy("buoy_id")
    out = legs(fixes).withColumns({"ok_speed": speed_mask(F.col("speed")), "ok_time": duration_mask(F.col("dt_s"))})
    counts = {"points_removed": F.count_if(~F.col("ok_speed")).over(own), "points_removed2": F.count_if(~F.col("ok_time")).over(own)}
    return out.withColumns({"ok": F.col("ok_speed") & F.col("ok_time"), **counts})


def clean(fixes: DataFrame) -> DataFrame:
    """Fixes that end a good leg; a track's first fix goes, and tracks with one fix left go."""
    good = masked(fixes).where(F.col("lon0").isNotNull() & F.col("ok"))
    return good.withColumn("_n", F.count("*").over(Window.partitionBy("buoy_id"))).where("_n > 1").drop("_n")


def normalise_drifters(fixes: DataFrame, box: tuple | None = None) -> DataFrame:
    """Longitudes 0-360 as negative ones, entry and exit, then the geofence, then legs without the first fix (C17)."""
    out = entry_exit(fixes.withColumn("lon", F.col("lon") - 360))
    if box:
        out = out.where(in_box(F.col("lon"), F.col("lat"), box, strict=False))
    return legs(out).where("lon0 is not null")


def with_times(fixes: DataFrame) -> DataFrame:
    """Tracks without missing times."""
    missing = F.count_if(F.col("ts").isNull()).over(Window.partitionBy("buoy_id"))
    return fixes.withColumn("_m", missing).where("_m = 0").drop("_m")


def quality_report(fixes: DataFrame, mapped: list[str] | None = None) -> DataFrame:
    """One row on legs, speeds, what the masks remove, and nulls in the columns ``mapped``."""
    m = masked(fixes).where("lon0 is not null")
    return m.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in mapped or []],
        F.count("*").alias("legs"),
        (F.count_if(F.col("speed") > FASTEST) * 100.0 / F.count("*")).alias("fast_pct"),
        (F.count_if(F.col("speed") < 0.0001) * 100.0 / F.count("*")).alias("slow_pct"),
        F.count_if(~F.col("ok_speed")).alias("removed_speed"),
        F.count_if(~F.col("ok_time")).alias("removed_time"),
        F.count_if(F.col("speed").isNull()).alias("no_speed"),
        F.max("speed").alias("max_speed"),
    )


def repeated_names(rows: DataFrame, name: str = "buoy_id") -> DataFrame:
    """All rows whose name occurs more than once (C20)."""
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(name))).where("_n > 1").drop("_n")


def rolling_mean(df: DataFrame, column: str, out: str, rows: int = 6, keep_null: bool = True, most_rows: int | None = None) -> DataFrame:
    """Centred mean over ``rows`` rows of a track, of an even number one more before than after."""
    df = df if keep_null else df.where(F.col(column).isNotNull())
    before, after = rows // 2, (rows - 1) // 2
    return over_track(df, lambda w: {out: F.avg(column).over(w.rowsBetween(-before, after))}, before, after, most_rows)


def magnitude(u: Column, v: Column) -> Column:
    """Speed of a mapped velocity."""
    return F.hypot(u, v)


def model_difference(df: DataFrame, u: str, v: str, of_magnitudes: bool = False) -> DataFrame:
    """Model velocity at the leg's start less the observed one, or the difference of their magnitudes."""
    mu, mv = F.lag(u).over(track()), F.lag(v).over(track())
    if of_magnitudes:
        return df.withColumn("diff", F.hypot(mu, mv) - F.col("speed"))
    return df.withColumns({"diff_u": mu - F.col("u"), "diff_v": mv - F.col("v")})


def with_month(df: DataFrame) -> DataFrame:
    """Month of each track's entry, to partition by."""
    return df.withColumn("mon_min", F.month(F.min("ts").over(Window.partitionBy("buoy_id"))))


def closest_approach(fixes: DataFrame, site: tuple[float, float]) -> DataFrame:
    """(buoy_id, lon, lat, km): where each polyline comes nearest to a site."""
    joined = legs(fixes).where("lon0 is not null")
    x, y = nearest_on_leg(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"), site)
    at = joined.select("buoy_id", "ts", "fix_id", x.alias("x"), y.alias("y"))
    planar = F.pow(F.col("x") - site[0], 2) + F.pow(F.col("y") - site[1], 2)
    best = at.groupBy("buoy_id").agg(F.min_by(F.struct("x", "y"), F.struct(planar, "ts", "fix_id")).alias("p"))
    best = best.select("buoy_id", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    return best.withColumn("km", haversine_km(F.col("lat"), F.col("lon"), F.lit(site[1]), F.lit(site[0])))
