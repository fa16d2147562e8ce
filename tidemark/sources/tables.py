"""Tables that are kept: appends that touch only partitions with new rows, and tracks with their geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.geo import in_box
from tidemark.operators.tracks import build_tracks
from tidemark.sources.scratch import written


def append_new(new: DataFrame, path: str, keys: list[str], part: str) -> int:
    """Add the rows of ``new`` whose keys the Parquet table at ``path``, partitioned by ``part``, lacks; their number (B2, A10).

    What is there stays: old rows win. Only partitions that get a row are read whole and written again, by dynamic
    overwrite from a copy in the shared folder; the others keep their files, and a second call with the same rows writes
    nothing. Of new rows with one key one is taken, the least. Keys and partitions are not null; a missing table is made.
    """
    spark = new.sparkSession
    others = [c for c in new.columns if c not in (*keys, part)]
    rank = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*others) if others else Window.partitionBy(*keys, part).orderBy(*keys))
    rows = new.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(folder):
        rows = written(rows, "new")
        rows.write.partitionBy(part).parquet(path)
        return rows.count()
    old = spark.read.schema(new.schema).parquet(path).select(*new.columns)
    fresh = written(rows.join(old.select(*keys, part), [*keys, part], "left_anti"), "fresh").select(*new.columns)
    added = fresh.count()
    if added:
        kept = old.join(F.broadcast(fresh.select(part).distinct()), part, "left_semi").select(*new.columns)
        merged = written(kept.unionByName(fresh), "merged")
        merged.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    return added


#: Little-endian LineString of the well-known binary form, before its number of points.
_LINE = bytes([1, 2, 0, 0, 0])


@F.pandas_udf(T.BinaryType())
def _line_bytes(lon: pd.Series, lat: pd.Series) -> pd.Series:
    return pd.Series([None if a is None else _LINE + len(a).to_bytes(4, "little") + np.stack([a, b], axis=1).astype("<f8").tobytes() for a, b in zip(lon, lat, strict=True)])


_POINTS = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


@F.pandas_udf(_POINTS)
def _line_points(line: pd.Series) -> pd.Series:
    def points(b: bytes) -> list[dict]:
        if b[:5] != _LINE:
            raise ValueError("not a little-endian LineString")
        return [{"lon": x, "lat": y} for x, y in np.frombuffer(b, "<f8", offset=9).reshape(-1, 2).tolist()]

    return pd.Series([None if b is None else points(b) for b in line])


def write_tracks(fixes: DataFrame, path: str, files: int | None = None) -> None:
    """One row for each track of two fixes or more: its line in well-known binary form, its times, and its extent.

    Tracks are dealt to files by their western edge and entry, so that the extents of a file's tracks are near each
    other and readers can leave files out. A track is one row, as in the form that others read.
    """
    t = build_tracks(fixes)
    lon, lat = F.transform("pts", lambda p: p["lon"]), F.transform("pts", lambda p: p["lat"])
    made = t.select("buoy_id", "entry_ts", "exit_ts", "n", F.transform("pts", lambda p: p["ts"]).alias("ts"), F.transform("pts", lambda p: p["fix_id"]).alias("fix_id"), _line_bytes(lon, lat).alias("geometry"), *[f(x).alias(n) for n, f, x in (("xmin", F.array_min, lon), ("ymin", F.array_min, lat), ("xmax", F.array_max, lon), ("ymax", F.array_max, lat))])
    dealt = made.repartitionByRange(files, "xmin", "entry_ts") if files else made.repartitionByRange("xmin", "entry_ts")
    dealt.sortWithinPartitions("xmin", "entry_ts").write.parquet(path)


def read_tracks(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Fixes (buoy_id, ts, fix_id, lon, lat) of the tracks at ``path``, all, or of those whose extent meets a box those inside it.

    Extents are plain columns, so the box reaches the scan and skips row groups and files.
    """
    rows = spark.read.parquet(path)
    if box:
        rows = rows.where((F.col("xmin") <= box[1]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[2]))
    each = rows.select("buoy_id", F.inline(F.arrays_zip("ts", "fix_id", _line_points("geometry").alias("p"))))
    fixes = each.select("buoy_id", "ts", "fix_id", "p.lon", "p.lat")
    return fixes.where(in_box(F.col("lon"), F.col("lat"), box, strict=False)) if box else fixes
