"""Appends that leave untouched files alone, and tracks that come back from their geometry as they were."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.geo import in_box
from tidemark.sources import tables

CELLS = "day string, lat double, u double"


def files(path):
    return {f"{d}/{f}" for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_only_partitions_with_new_rows_are_written(spark, tmp_path):
    path = f"{tmp_path}/cells"
    old = [(f"2024-01-{d:02d}", float(lat), d + lat / 8) for d in range(1, 6) for lat in range(10)]
    assert tables.append_new(spark.createDataFrame(old, CELLS), path, ["lat"], "day") == 50
    before = files(path)
    new = [("2024-01-03", 4.0, 99.0), ("2024-01-03", 50.0, 1.0), ("2024-01-03", 50.0, 0.5), ("2024-01-09", 1.0, 2.0), ("2024-01-05", 9.0, 77.0)]
    df = spark.createDataFrame(new, CELLS)
    assert tables.append_new(df, path, ["lat"], "day") == 2
    after = files(path)
    touched = {f for f in before if "day=2024-01-03" in f}
    assert before - after == touched and {f.split("/day=")[1][:10] for f in after - before} == {"2024-01-03", "2024-01-09"}
    rows = sorted((r.day, r.lat, r.u) for r in spark.read.schema(CELLS).parquet(path).collect())
    assert rows == sorted([*old, ("2024-01-03", 50.0, 0.5), ("2024-01-09", 1.0, 2.0)])
    assert tables.append_new(df, path, ["lat"], "day") == 0 and files(path) == after


def test_tracks_come_back(spark, tmp_path):
    rng = random.Random(1)
    rows = [(b, b * 100 + i, datetime(2024, 1, 1) + timedelta(hours=i), b * 2.0 - 170 + rng.random(), rng.uniform(4, 8)) for b in range(30) for i in range(1 if b == 3 else rng.randint(2, 9))]
    fixes = spark.createDataFrame(rows, "buoy_id long, fix_id long, ts timestamp, lon double, lat double")
    path = f"{tmp_path}/tracks"
    tables.write_tracks(fixes, path, files=6)
    assert sorted(map(tuple, tables.read_tracks(spark, path).select(*fixes.columns).collect())) == sorted(r for r in rows if r[0] != 3)
    box = (-150.0, -148.5, 4.0, 6.0)
    part = tables.read_tracks(spark, path, box)
    want = fixes.where("buoy_id <> 3").where(in_box(F.col("lon"), F.col("lat"), box, strict=False))
    assert sorted(map(tuple, part.select(*fixes.columns).collect())) == sorted(map(tuple, want.collect())) and want.count() > 0
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "LessThanOrEqual(xmin,-148.5)" in plan
    # of the six files only those whose extents meet the box have a row group left
    import pyarrow.parquet as pq

    left = 0
    for f in files(path):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        stats = {n: meta.row_group(0).column(at[n]).statistics for n in ("xmin", "xmax")}
        left += stats["xmin"].min <= box[1] and stats["xmax"].max >= box[0]
    assert 0 < left <= 3
    line = spark.read.parquet(path).select("geometry", "n").first()
    assert line.geometry[:5] == b"\x01\x02\x00\x00\x00" and len(line.geometry) == 9 + 16 * line.n
