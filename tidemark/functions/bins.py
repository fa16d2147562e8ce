"""One binning helper, closed on the right or on the left, and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def equal_bin(x: Column, low: float | Column, width: float | Column, n: int, closed: str = "right") -> Column:
    """Number 0..n-1 of the equal bin that holds x, null outside.

    closed 'right': (low, low+width], ...; 'left': [low, low+width), ...; 'both': as left with the last bin closed.
    """
    at = (x - low) / width
    if closed == "right":
        number = F.ceil(at) - 1
    else:
        number = F.floor(at)
        if closed == "both":
            number = F.when(at == n, n - 1).otherwise(number)
    return F.when((number >= 0) & (number < n), number.cast("int"))


def edge_bin(x: Column, edges: list[float], closed: str = "right") -> Column:
    """Number of the bin between given rising edges that holds x, null outside."""
    out = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if closed == "right":
            inside = (x > lo) & (x <= hi)
        else:
            inside = (x >= lo) & ((x <= hi) if closed == "both" and i == len(edges) - 2 else (x < hi))
        out = F.when(inside, i).otherwise(out)
    return out


def histogram2d(df: DataFrame, x: str, y: str, x_bins: tuple[float, float, int], y_bins: tuple[float, float, int]) -> DataFrame:
    """(ix, iy, n): counts over two sets of equal bins (low, width, number), the last closed; empty cells left out."""
    ix = equal_bin(F.col(x), *x_bins, closed="both")
    iy = equal_bin(F.col(y), *y_bins, closed="both")
    return df.select(ix.alias("ix"), iy.alias("iy")).dropna().groupBy("ix", "iy").agg(F.count("*").alias("n"))


def marginal_slopes(hist: DataFrame, x_bins: tuple[float, float, int], y_bins: tuple[float, float, int]) -> DataFrame:
    """(axis, slope, intercept): straight lines through a histogram's mean counts by column and by row.

    Empty cells count as 0; the largest mean (of equal ones the first) gives way to the mean of all; x is a bin's left edge.
    """
    lines = []
    for axis, (low, width, n), others in (("ix", x_bins, y_bins[2]), ("iy", y_bins, x_bins[2])):
        spine = hist.sparkSession.range(n).select(F.col("id").cast("int").alias(axis))
        means = spine.join(hist.groupBy(axis).agg(F.sum("n").alias("n")), axis, "left").select(axis, (F.coalesce("n", F.lit(0)) / others).alias("m"))
        top = F.row_number().over(Window.orderBy(F.desc("m"), axis)) == 1
        y = F.when(top, F.avg("m").over(Window.partitionBy())).otherwise(F.col("m"))
        line = means.select((low + F.col(axis) * width).alias("x"), y.alias("y"))
        lines.append(line.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")).select(F.lit(axis).alias("axis"), "slope", "intercept"))
    return lines[0].unionByName(lines[1])
