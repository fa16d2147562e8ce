"""Windows and running sums over tracks of any length: long tracks are cut into ranges of time that carry what crosses their edges.

A window over a whole track sorts it in one task. Here only tracks of more than ``most_rows`` fixes are cut; what a range
needs of its neighbours (a few rows, or a sum) comes from a table with a row for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.search import position

#: Buckets of the histogram by which a long track is cut, for each range that it needs.
FINE = 16


def in_ranges(df: DataFrame, most_rows: int, key: str = "buoy_id", ts: str = "ts") -> DataFrame:
    """``df`` with _range (int): 0 for all rows of a track of at most ``most_rows``, else the number of its range of time.

    A long track's rows are counted in FINE buckets for each range that it needs; a range takes buckets until it
    has ``most_rows``, so it holds less than that and one bucket more, unless times crowd in a bucket. Long tracks
    are few (at most rows / most_rows), and so are all cuts together, which are broadcast. Rows of a null time are
    in the first range.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    long = df.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"), F.min(us).alias("_from"), F.max(us).alias("_to")).where(F.col("_n") > most_rows)
    long = long.select("_key", "_from", F.greatest((F.col("_to") - F.col("_from")) / (FINE * F.ceil(F.col("_n") / most_rows)), F.lit(1.0)).alias("_width"))
    timed = df.select(F.col(key).alias("_key"), us.alias("_us")).where("_us is not null").join(F.broadcast(long), "_key")
    counts = timed.groupBy("_key", F.floor((F.col("_us") - F.col("_from")) / F.col("_width")).alias("_bucket")).agg(F.count("*").alias("_n"), F.min("_us").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_key").orderBy("_bucket")) - F.col("_n")
    starts = counts.withColumn("_cut", F.floor(before / most_rows)).groupBy("_key", "_cut").agg(F.min("_first").alias("_first"))
    cuts = starts.groupBy("_key").agg(F.sort_array(F.collect_list("_first")).alias("_cuts"))
    joined = df.join(F.broadcast(cuts), F.col(key) == F.col("_key"), "left")
    return joined.withColumn("_range", F.when(F.col("_cuts").isNull() | us.isNull(), 0).otherwise(position(us, F.col("_cuts")))).drop("_key", "_cuts")


def over_track(df: DataFrame, made: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0, most_rows: int | None = None, key: str = "buoy_id", ts: str = "ts", tie: str = "fix_id") -> DataFrame:
    """``df`` with the columns of ``made``, window expressions that look ``before`` rows back and ``after`` rows ahead in a track at most.

    With ``most_rows`` the window runs over ranges of in_ranges(); each range is lent the last rows of those before
    it and the first of those after it, which go again once the window is through.
    """
    if most_rows is None:
        return df.withColumns(made(Window.partitionBy(key).orderBy(ts, tie)))
    dealt = in_ranges(df, most_rows, key, ts)
    part = Window.partitionBy(key, "_range")
    edge = dealt.withColumns({"_up": F.row_number().over(part.orderBy(ts, tie)), "_down": F.row_number().over(part.orderBy(F.col(ts).desc(), F.col(tie).desc()))})
    edge = edge.where((F.col("_down") <= before) | (F.col("_up") <= after))
    row = F.struct(F.col(ts).alias("_t"), F.col(tie).alias("_i"), F.struct(*df.columns).alias("_row"))
    ends = edge.groupBy(key, "_range").agg(F.array_sort(F.collect_list(F.when(F.col("_down") <= before, row))).alias("_last"), F.array_sort(F.collect_list(F.when(F.col("_up") <= after, row))).alias("_first"))
    ordered = Window.partitionBy(key).orderBy("_range")
    near = ends.withColumns({"_back": F.flatten(F.collect_list("_last").over(ordered.rowsBetween(-before, -1) if before else ordered.rowsBetween(0, 0))), "_ahead": F.flatten(F.collect_list("_first").over(ordered.rowsBetween(1, after) if after else ordered.rowsBetween(0, 0)))})
    lent = F.concat(F.slice("_back", F.greatest(F.size("_back") - before + 1, F.lit(1)), before), F.slice("_ahead", 1, after))
    ghosts = near.select("_range", F.explode(lent["_row"]).alias("_row")).select("_row.*", "_range", F.lit(True).alias("_lent"))
    both = dealt.withColumn("_lent", F.lit(False)).unionByName(ghosts)
    return both.withColumns(made(part.orderBy(ts, tie))).where(~F.col("_lent")).drop("_lent", "_range")


def running_sum(df: DataFrame, value: str, out: str, most_rows: int | None = None, key: str = "buoy_id", ts: str = "ts", tie: str = "fix_id") -> DataFrame:
    """``df`` with the sum of ``value`` over a track's rows up to each; a range starts from the sums of those before it."""
    if most_rows is None:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(key).orderBy(ts, tie)))
    dealt = in_ranges(df, most_rows, key, ts)
    sums = dealt.groupBy(F.col(key).alias("_key"), F.col("_range").alias("_of")).agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_carried", F.sum("_sum").over(Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1))).drop("_sum")
    own = dealt.withColumn(out, F.sum(value).over(Window.partitionBy(key, "_range").orderBy(ts, tie)))
    joined = own.join(sums, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return joined.withColumn(out, F.coalesce(F.col(out) + F.col("_carried"), out, "_carried")).drop("_key", "_of", "_carried", "_range")
