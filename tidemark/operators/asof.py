"""Nearest as-of joins by one shuffle: both sides in one order, looking back and forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, right_cols: list[str], tolerance_s: float | None, tie: str = "fix_id", bucket_s: int | None = None) -> DataFrame:
    """``left`` with the right row of the same keys nearest in time, at most ``tolerance_s`` away.

    The earlier of two as near wins; of right rows at one time, the last by ``tie`` backward or at the same time and the first
    forward; left rows without a match get nulls. Null times match nothing. With ``bucket_s`` (at least the
    tolerance) rows are also dealt by time, right rows to the next and the last bucket too, which splits
    hot keys.
    """
    picked = F.struct(F.unix_micros(F.col(right_ts).cast("timestamp")).alias("us"), F.col(right_ts).alias("at"), *[F.col(c) for c in right_cols])
    lus, rus = F.unix_micros(F.col(left_ts).cast("timestamp")), F.unix_micros(F.col(right_ts).cast("timestamp"))
    a = left.select(*keys, lus.alias("_us"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_tie"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    b = right.where(F.col(right_ts).isNotNull()).select(*keys, rus.alias("_us"), F.lit(0).alias("_side"), F.col(tie).cast("long").alias("_tie"), F.lit(None).alias("_l"), picked.alias("_r"))
    part = list(keys)
    if bucket_s:
        size = bucket_s * 1_000_000
        a = a.withColumn("_bucket", F.floor(F.col("_us") / size))
        b = b.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_us") / size) - 1, F.floor(F.col("_us") / size) + 1)))
        part.append("_bucket")
    w = Window.partitionBy(*part).orderBy("_us", "_side", "_tie")
    both = a.unionByName(b)
    both = both.withColumns({"_prev": F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_next": F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    both = both.where("_side = 1")
    back, ahead = F.col("_us") - F.col("_prev.us"), F.col("_next.us") - F.col("_us")
    best = F.when(ahead.isNull() | (back <= ahead), F.col("_prev")).otherwise(F.col("_next"))
    gap = F.when(ahead.isNull() | (back <= ahead), back).otherwise(ahead)
    if tolerance_s is not None:
        best = F.when(gap <= int(tolerance_s * 1e6), best)
    both = both.withColumn("_best", best)
    return both.select("_l.*", F.col("_best.at").alias("matched_ts"), *[F.col(f"_best.{c}").alias(f"{c}_right" if c in left.columns else c) for c in right_cols])


def around(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str]) -> DataFrame:
    """``left`` with each of ``values`` linear in time between the right rows before and after it.

    Only left rows strictly inside the right series get values; others get nulls.
    """
    picked = F.struct(F.unix_micros(F.col(right_ts).cast("timestamp")).alias("us"), *values)
    a = left.select(*keys, F.unix_micros(F.col(left_ts).cast("timestamp")).alias("_us"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).alias("_r"))
    b = right.select(*keys, F.unix_micros(F.col(right_ts).cast("timestamp")).alias("_us"), F.lit(0).alias("_side"), F.lit(None).alias("_l"), picked.alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_us", "_side")
    own = Window.partitionBy(*keys)
    both = a.unionByName(b).withColumns(
        {
            "_prev": F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "_next": F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
            "_from": F.min("_r.us").over(own),
            "_to": F.max("_r.us").over(own),
        }
    )
    both = both.where("_side = 1")
    share = F.try_divide((F.col("_us") - F.col("_prev.us")).cast("double"), (F.col("_next.us") - F.col("_prev.us")).cast("double"))
    inside = (F.col("_us") > F.col("_from")) & (F.col("_us") < F.col("_to"))
    made = [F.when(inside, F.when(F.col("_us") == F.col("_prev.us"), F.col(f"_prev.{v}")).otherwise(F.col(f"_prev.{v}") + (F.col(f"_next.{v}") - F.col(f"_prev.{v}")) * share)).alias(v) for v in values]
    return both.select("_l.*", inside.alias("inside"), *made)
