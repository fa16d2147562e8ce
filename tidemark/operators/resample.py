"""Resampling of irregular series to regular axes. Axes are whole numbers (micros, or units of the caller)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.search import stretch
from tidemark.sources.scratch import written


def _linear(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * F.try_divide((x - x0).cast("double"), (x1 - x0).cast("double")))


def regular(df: DataFrame, keys: list[str], x: str, values: list[str], step: int, origin: str | None = None, clamp: bool = True, positional: bool = False) -> DataFrame:
    """(keys, x, i, values) at start, start+step, ... of each series; ``x`` is a long column.

    The start is the first x, or ``origin`` (a column). Values are linear in x between neighbours; of rows with one x
    the first (by value) stays. With ``clamp`` the targets go on while < last + step, the last held at the last
    value; else they end at the last x. ``positional`` spaces targets between two rows evenly, as interpolation by row number does.
    """
    w = Window.partitionBy(*keys).orderBy(x)
    own = Window.partitionBy(*keys)
    one = df.groupBy(*keys, x, *([origin] if origin else [])).agg(F.min(F.struct(*values)).alias("_v"))
    one = one.withColumns({"_x1": F.lead(x).over(w), "_v1": F.lead("_v").over(w), "_o": F.col(origin) if origin else F.min(x).over(own)})
    x0 = F.col(x)
    first = F.ceil((x0 - F.col("_o")) / step).cast("long")
    last = F.when(F.col("_x1").isNotNull(), F.ceil((F.col("_x1") - F.col("_o")) / step).cast("long") - 1)
    end = F.ceil((x0 + step - F.col("_o")) / step).cast("long") - 1 if clamp else F.floor((x0 - F.col("_o")) / step).cast("long")
    one = one.withColumns({"_a": first, "_b": F.coalesce(last, end)})
    made = one.where("_b >= _a").withColumn("i", F.explode(F.sequence("_a", "_b")))
    target = F.col("_o") + F.col("i") * step
    out = []
    for v in values:
        y0, y1 = F.col(f"_v.{v}"), F.col(f"_v1.{v}")
        if positional:
            # a target between two rows takes its place among the rows and targets between them
            share = (F.col("i") - F.col("_a") + F.when((x0 - F.col("_o")) % step == 0, 0).otherwise(1)) / (F.col("_b") - F.col("_a") + F.when((x0 - F.col("_o")) % step == 0, 1).otherwise(2))
            value = y0 + (y1 - y0) * share
        else:
            value = _linear(target, x0, y0, F.col("_x1"), y1)
        out.append(F.when(F.col("_x1").isNull(), y0).otherwise(value).alias(v))
    return made.select(*keys, target.alias(x), "i", *out)


def dense_grid(df: DataFrame, keys: list[str], x: str, values: list[str], step: int) -> DataFrame:
    """The series' own points and those of a regular grid from 0, values linear between."""
    grid = regular(df.withColumn("_zero", F.lit(0).cast("long")), keys, x, values, step, origin="_zero", clamp=False)
    own = df.groupBy(*keys, x).agg(F.min(F.struct(*values)).alias("_v")).select(*keys, x, *[F.col(f"_v.{v}").alias(v) for v in values])
    return own.unionByName(grid.select(*keys, x, *values)).dropDuplicates([*keys, x])


def coefficients_at(points: DataFrame, surface: DataFrame, lead: str = "lead_h", keys: list[str] | None = None, values: list[str] | None = None) -> DataFrame:
    """``points`` with the surface's values at any lead, a row for each of its keys, linear, and extended beyond both ends.

    ``surface`` (keys, lead, values) is a table of coefficients: at most a few hundred rows by what it is. The leads at which
    any key's segment changes are put in the plan as nested cases, which number the stretches between them; a point meets
    the segments of its stretch by equality. Keys of a single lead have no segment.
    """
    keys, values = keys or ["q"], values or ["b0"]
    table = written(surface.select(*keys, F.col(lead).cast("double").alias("_x"), *values), "surface")
    w = Window.partitionBy(*keys).orderBy("_x", *values)
    ends = {"_k": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy(*keys)), "_b": F.lead(F.struct("_x", *values)).over(w)}
    segments = table.withColumns(ends).where(F.col("_k") < F.col("_n"))
    changes = sorted(r[0] for r in segments.where("_k > 1").select("_x").distinct().collect())
    stretches = points.sparkSession.createDataFrame([(i, None if i == 0 else changes[i - 1]) for i in range(len(changes) + 1)], "_stretch int, _from double")
    held = ((F.col("_k") == 1) | F.coalesce(F.col("_from") >= F.col("_x"), F.lit(False))) & ((F.col("_k") == F.col("_n") - 1) | F.coalesce(F.col("_from") < F.col("_b._x"), F.lit(True)))
    own = segments.join(F.broadcast(stretches), held).select("_stretch", *keys, F.struct("_x", *values).alias("_a"), "_b")
    joined = points.where(F.col(lead).isNotNull()).withColumn("_stretch", stretch(F.col(lead), changes)).join(F.broadcast(own), "_stretch")
    share = (F.col(lead) - F.col("_a._x")) / (F.col("_b._x") - F.col("_a._x"))
    return joined.select(*points.columns, *keys, *[(F.col(f"_a.{v}") + (F.col(f"_b.{v}") - F.col(f"_a.{v}")) * share).alias(v) for v in values])


def nearest_row(points: DataFrame, axis: DataFrame, p: str, a: str) -> DataFrame:
    """``points`` with the axis value nearest to p, the smaller of two as near (E9); the axis is a small table."""
    best = axis.agg(F.sort_array(F.collect_set(a)).alias("_axis"))
    pick = F.array_min(F.transform("_axis", lambda x: F.struct(F.abs(x - F.col(p)).alias("d"), x.alias("x"))))["x"]
    return points.join(F.broadcast(best)).withColumn(f"nearest_{a}", pick).drop("_axis")
