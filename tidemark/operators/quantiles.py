"""Exact quantiles of groups of any size, by selection: no task holds the values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import written

#: Values of an interval that are sorted at last, and bins into which a larger one is parted.
FEW, BINS = 100_000, 1024


def _within(x: Column) -> Column:
    return (x >= F.col("lo")) & (x <= F.col("hi"))


def select(df: DataFrame, keys: list[str], value: str, quantiles: list[float] | tuple, few: int = FEW, bins: int = BINS) -> DataFrame:
    """(keys, n, quantiles): for each group the number of its values and an array of their exact quantiles, linear between ranks.

    Each quantile lies between two ranks. For every group that has more than ``few`` values the interval from the
    least to the greatest is parted into ``bins``, the values are counted in each, and only the bins that hold a
    wanted rank are kept, from their own least to their own greatest value; and so on until an interval has
    ``few`` values or one. These are then counted by value and ranked. Each pass reads the values once and forms
    partial counts where they are, bins times wanted ranks for each group at most; there are log(n / few) / log(bins)
    passes where values spread evenly, more where they span many orders of magnitude. Null and NaN are left out;
    null keys form groups of their own.
    """
    rows = df.select(F.struct(*keys).alias("g") if keys else F.struct(F.lit(0).alias("_")).alias("g"), F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    groups = written(rows.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "groups")
    position = F.col("q") * (F.col("n") - 1)
    wanted = groups.select("g", "n", F.posexplode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("i", "q"))
    wanted = wanted.select("g", "i", (position - F.floor(position)).alias("share"), F.explode(F.array(F.floor(position), F.least(F.floor(position) + 1, F.col("n") - 1))).alias("rank")).distinct()
    ranks = written(wanted.groupBy("g", "i", "share").agg(F.min("rank").alias("low"), F.max("rank").alias("high")), "ranks")
    each = ranks.select("g", F.explode(F.array("low", "high")).alias("rank")).distinct()
    state = groups.select("g", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"))
    large = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
    while state.where(large).limit(1).count():
        opened = state.where(large)
        bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
        counts = rows.join(opened, "g").where(_within(F.col("x"))).groupBy("g", "lo", "below", bin_.alias("bin")).agg(F.count("*").alias("inside"), F.min("x").alias("least"), F.max("x").alias("most"))
        before = F.sum("inside").over(Window.partitionBy("g", "lo", "below").orderBy("bin")) - F.col("inside")
        parts = counts.withColumn("below", F.col("below") + before).select("g", F.col("least").alias("lo"), F.col("most").alias("hi"), "below", "inside")
        held = parts.join(each, "g").where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("inside"))).drop("rank").distinct()
        state = written(state.where(~large).unionByName(held), "intervals")
    counts = rows.join(state, "g").where(_within(F.col("x"))).groupBy("g", "below", "x").agg(F.count("*").alias("times"))
    upto = F.col("below") + F.sum("times").over(Window.partitionBy("g", "below").orderBy("x"))
    ranked = counts.withColumn("upto", upto).withColumn("after", F.col("upto") - F.col("times"))
    found = ranked.join(each, "g").where((F.col("rank") >= F.col("after")) & (F.col("rank") < F.col("upto"))).select("g", "rank", "x")
    ends = found.groupBy("g").agg(F.map_from_entries(F.collect_set(F.struct("rank", "x"))).alias("at"))
    low, high = F.element_at("at", F.col("low")), F.element_at("at", F.col("high"))
    values = ranks.join(ends, "g").select("g", "i", (low * (1 - F.col("share")) + high * F.col("share")).alias("v"))
    out = values.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).join(groups.select("g", "n"), "g")
    return out.select(*[F.col(f"g.{k}").alias(k) for k in keys], "n", F.col("v.v").alias("quantiles"))
