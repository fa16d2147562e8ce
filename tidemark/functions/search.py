"""Bisection in sorted array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Halvings, enough for arrays of 2^31 values; they end early where nothing is left to halve.
HALVINGS = 31


def position(x: Column, axis: Column, halvings: int = HALVINGS) -> Column:
    """Position (from 0) of the last value of a sorted array that is not greater than x; 0 if there is none."""

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        up = F.get(axis, mid) <= x
        return F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid - 1).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), (F.size(axis) - 1).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve)["lo"]


def stretch(x: Column, rising: list[float]) -> Column:
    """How many of a few rising values are not greater than x, by nested cases: compiled, where position() is interpreted."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x >= F.lit(rising[mid]), among(mid + 1, high)).otherwise(among(low, mid))

    return among(0, len(rising))
