"""Latitude profiles by season, and how they vary from year to year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _place(step: float, ts: str) -> list:
    """Number of the latitude bin, closed on the left, and the quarter of the year."""
    return [F.floor(F.col("lat") / step).cast("int").alias("iy"), F.quarter(ts).alias("season")]


def seasonal_profile(rows: DataFrame, value: str, step: float = 0.25, ts: str = "ts", by_year: bool = False) -> DataFrame:
    """(iy, season[, year], value): the mean of a column by latitude bin and season, of each year if asked."""
    keys = [*_place(step, ts), *([F.year(ts).alias("year")] if by_year else [])]
    return rows.groupBy(*keys).agg(F.avg(value).alias(value))


def interannual_error(rows: DataFrame, value: str, step: float = 0.25, ts: str = "ts") -> DataFrame:
    """(iy, season, se, n_years): sample deviation of the yearly profiles over the root of their number.

    Years without a value do not count; a single year has no deviation, so its error is null.
    """
    yearly = seasonal_profile(rows, value, step, ts, by_year=True)
    return yearly.groupBy("iy", "season").agg(F.try_divide(F.stddev_samp(value), F.sqrt(F.count(value))).alias("se"), F.count(value).alias("n_years"))
