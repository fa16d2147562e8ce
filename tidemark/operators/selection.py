"""Filters, activity and selection of tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import in_box, segment_meets_box
from tidemark.operators.tracks import legs


def spans(fixes: DataFrame) -> DataFrame:
    """(buoy_id, entry_ts, exit_ts) and the extent of each track."""
    return fixes.groupBy("buoy_id").agg(F.min("ts").alias("entry_ts"), F.max("ts").alias("exit_ts"), F.min("lon").alias("lon0"), F.max("lon").alias("lon1"), F.min("lat").alias("lat0"), F.max("lat").alias("lat1"))


def active_at(tracks: DataFrame, t: str) -> DataFrame:
    """Tracks with entry <= t <= exit."""
    return tracks.where((F.col("entry_ts") <= F.lit(t).cast("timestamp")) & (F.col("exit_ts") >= F.lit(t).cast("timestamp")))


def active_in(tracks: DataFrame, start: str, end: str) -> DataFrame:
    """Tracks whose time overlaps a range."""
    return tracks.where((F.col("entry_ts") <= F.lit(end).cast("timestamp")) & (F.col("exit_ts") >= F.lit(start).cast("timestamp")))


def select_fixes(fixes: DataFrame, buoy: int | None = None, after: str | None = None, before: str | None = None, box: tuple | None = None) -> DataFrame:
    """Fixes by buoy, times (exclusive) and box (inclusive), each optional (D3)."""
    if buoy is not None:
        fixes = fixes.where(F.col("buoy_id") == buoy)
    if after is not None:
        fixes = fixes.where(F.col("ts") > F.lit(after).cast("timestamp"))
    if before is not None:
        fixes = fixes.where(F.col("ts") < F.lit(before).cast("timestamp"))
    return fixes.where(in_box(F.col("lon"), F.col("lat"), box, strict=False)) if box else fixes


def any_part_in(fixes: DataFrame, start: str | None = None, end: str | None = None, lon: tuple | None = None, lat: tuple | None = None) -> DataFrame:
    """(buoy_id) of tracks that overlap a range of time, and whose line meets the box or whose extent overlaps one axis."""
    tracks = spans(fixes)
    if start and end:
        tracks = active_in(tracks, start, end)
    if lon and lat:
        box = (*lon, *lat)
        met = segment_meets_box(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"), box)
        crossing = legs(fixes).where("lon0 is not null").where(met).select("buoy_id").distinct()
        return tracks.select("buoy_id").join(crossing, "buoy_id", "left_semi")
    if lon:
        tracks = tracks.where((F.col("lon0") <= lon[1]) & (F.col("lon1") >= lon[0]))
    if lat:
        tracks = tracks.where((F.col("lat0") <= lat[1]) & (F.col("lat1") >= lat[0]))
    return tracks.select("buoy_id")


def one_track(fixes: DataFrame, buoy: int) -> DataFrame:
    """A single track as (ts, lat_true, lon_true)."""
    return fixes.where(F.col("buoy_id") == buoy).select("ts", F.col("lat").alias("lat_true"), F.col("lon").alias("lon_true"))


def active_by_events(fixes: DataFrame) -> DataFrame:
    """(day, active): entries so far less exits up to the day, over all days between the first and last.

    Days are few, so the running sum is over one small table.
    """
    tracks = spans(fixes)
    change = tracks.select(F.explode(F.array(F.struct(F.to_date("entry_ts").alias("day"), F.lit(1).alias("d")), F.struct(F.to_date("exit_ts").alias("day"), F.lit(-1).alias("d")))).alias("x")).select("x.*")
    change = change.groupBy("day").agg(F.sum("d").alias("d"))
    days = change.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return days.join(change, "day", "left").select("day", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("day")).alias("active"))


def active_intervals(fixes: DataFrame, gap_days: int) -> DataFrame:
    """(buoy_id, first_day, last_day): spans of days in which a buoy was seen, never ``gap_days`` or more apart.

    Days are made distinct where the fixes are, so a track has a row for each day at most.
    """
    w = Window.partitionBy("buoy_id").orderBy("day")
    days = fixes.select("buoy_id", F.to_date("ts").alias("day")).where("day is not null").distinct()
    new = F.coalesce(F.datediff("day", F.lag("day").over(w)) >= gap_days, F.lit(False)).cast("int")
    spans_ = days.withColumn("_new", new).withColumn("_span", F.sum("_new").over(w)).groupBy("buoy_id", "_span")
    return spans_.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day")).drop("_span")


def active_with_reentry(fixes: DataFrame, gap_days: int = 3) -> DataFrame:
    """(day, active): buoys within one of their active_intervals, from the first day to the last of all.

    A buoy that leaves for ``gap_days`` or more counts neither while it is away nor twice when it is back. The sweep adds
    one on each first day and takes one after each last; days are few, so its running sum is over one small table.
    """
    ends = F.inline(F.array(F.struct(F.col("first_day").alias("day"), F.lit(1).alias("d")), F.struct(F.date_add("last_day", 1).alias("day"), F.lit(-1).alias("d"))))
    change = active_intervals(fixes, gap_days).select(ends).groupBy("day").agg(F.sum("d").alias("d"))
    days = change.agg(F.explode(F.sequence(F.min("day"), F.date_sub(F.max("day"), 1))).alias("day"))
    return days.join(change, "day", "left").select("day", F.sum(F.coalesce("d", F.lit(0))).over(Window.orderBy("day")).alias("active"))


def active_by_observation(fixes: DataFrame, approximate: bool = False) -> DataFrame:
    """(day, year, active): buoys seen each day."""
    count = F.approx_count_distinct("buoy_id") if approximate else F.count_distinct("buoy_id")
    return fixes.groupBy(F.to_date("ts").alias("day")).agg(count.alias("active")).withColumn("year", F.year("day"))


def latest_segments(fixes: DataFrame, day: str, gap_days: int = 2) -> DataFrame:
    """Fixes before a day of buoys last seen the day before, since their last gap of ``gap_days`` or more."""
    w = Window.partitionBy("buoy_id").orderBy("ts", "fix_id")
    own = Window.partitionBy("buoy_id")
    past = fixes.withColumn("day", F.to_date("ts")).where(F.col("day") < F.lit(day).cast("date"))
    past = past.withColumn("last_day", F.max("day").over(own)).where(F.col("last_day") == F.date_sub(F.lit(day).cast("date"), 1))
    new = F.coalesce(F.datediff("day", F.lag("day").over(w)) >= gap_days, F.lit(False)).cast("int")
    past = past.withColumn("segment", F.sum(new).over(w))
    return past.withColumn("_top", F.max("segment").over(own)).where("segment = _top").drop("_top", "last_day")


def last_fixes(fixes: DataFrame) -> DataFrame:
    """(buoy_id, lon, lat) of each buoy's last fix."""
    last = F.max_by(F.struct("lon", "lat"), F.struct("ts", "fix_id"))
    return fixes.groupBy("buoy_id").agg(last.alias("p")).select("buoy_id", "p.lon", "p.lat")


def mean_centre(points: DataFrame) -> DataFrame:
    """Mean position."""
    return points.agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))


def clip(fixes: DataFrame, start: str, end: str) -> DataFrame:
    """Fixes in a closed window, of tracks that keep more than one."""
    inside = fixes.where(F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return inside.withColumn("_n", F.count("*").over(Window.partitionBy("buoy_id"))).where("_n > 1").drop("_n")


def subset(fixes: DataFrame, ids: DataFrame) -> DataFrame:
    """Fixes of the buoys listed."""
    return fixes.join(ids.select("buoy_id"), "buoy_id", "left_semi")


def within_fields(tracks: DataFrame, fields: DataFrame) -> DataFrame:
    """Tracks wholly inside the time that all fields (start_ts, end_ts) cover, exclusive."""
    common = fields.agg(F.max("start_ts").alias("_from"), F.min("end_ts").alias("_to"))
    return tracks.join(common, (F.col("entry_ts") > F.col("_from")) & (F.col("exit_ts") < F.col("_to"))).drop("_from", "_to")
