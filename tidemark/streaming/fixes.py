"""Streaming forms of track operators over a stream of fixes (buoy_id, ts, lon, lat, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(fixes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each fix once, repeats looked for as long as the watermark keeps them."""
    return fixes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["buoy_id", "ts", "lon", "lat"])


def segments(fixes: DataFrame, gap: str = "26 hours", late: str = "1 hour") -> DataFrame:
    """(buoy_id, start, end, n): segments between gaps, given out when the watermark has passed them."""
    window = F.session_window("ts", gap)
    made = fixes.withWatermark("ts", late).groupBy("buoy_id", window.alias("w")).agg(F.count("*").alias("n"))
    return made.select("buoy_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def daily_active(fixes: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, active): about how many buoys report each day."""
    made = fixes.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(F.approx_count_distinct("buoy_id").alias("active"))
    return made.select(F.to_date("w.start").alias("day"), "active")
