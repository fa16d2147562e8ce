"""Windows over ranges of long tracks: the same rows as over whole tracks, and no task with a large share."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import scan, spectra, tracks


def fixes(spark, n, seed=1):
    """``n`` fixes, nine of ten of buoy 7: bursts, gaps, equal times and a null time."""
    rng = random.Random(seed)
    clock = {b: datetime(2024, 1, 1) for b in range(12)}
    rows = []
    for i in range(n):
        b = 7 if rng.random() < 0.9 else rng.randrange(12)
        clock[b] += timedelta(seconds=rng.choice([0, 1, 60, 60, 3600, 3600, 90000, 900000]) if rng.random() < 0.7 else 5)
        rows.append((b, i, clock[b], rng.uniform(-164, -160), rng.uniform(4, 8), rng.choice([None, 1, 2])))
    rows += [(7, n, None, -161.0, 5.0, 1), (None, n + 1, datetime(2024, 1, 1), -161.0, 5.0, 1)]
    return spark.createDataFrame(rows, "buoy_id long, fix_id long, ts timestamp, lon double, lat double, x long").repartition(9)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("most", [1, 3, 40, 100000])
def test_same_as_whole_tracks(spark, most):
    f = fixes(spark, 600)
    assert rows(tracks.legs(f, most_rows=most)) == rows(tracks.legs(f))
    assert rows(spectra.split_at_gaps(f, 72, most_rows=most)) == rows(spectra.split_at_gaps(f, 72))

    def made(w):
        near = w.rowsBetween(-5, 4)
        return {"n": F.count("x").over(near), "s": F.sum("fix_id").over(near), "p": F.lag("fix_id", 5).over(w), "q": F.lead("fix_id", 4).over(w)}

    assert rows(scan.over_track(f, made, 5, 4, most)) == rows(scan.over_track(f, made, 5, 4))
    want = f.withColumn("s", F.sum("x").over(Window.partitionBy("buoy_id").orderBy("ts", "fix_id")))
    assert rows(scan.running_sum(f, "x", "s", most)) == rows(want)


def test_no_range_is_large(spark):
    f = fixes(spark, 20000, 2)
    dealt = scan.in_ranges(f, 500)
    sizes = {(r.buoy_id, r._range): r["count"] for r in dealt.groupBy("buoy_id", "_range").count().collect()}
    assert sum(sizes.values()) == 20002 and max(sizes.values()) < 0.1 * 20002
    tasks = scan.over_track(f, lambda w: {"p": F.lag("fix_id").over(w), "task": F.spark_partition_id()}, 1, 0, 500)
    spark.conf.set("spark.sql.shuffle.partitions", 64)
    try:
        largest = tasks.groupBy("task").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert largest < 0.6 * 20002


def test_empty(spark):
    f = fixes(spark, 10).limit(0)
    assert tracks.legs(f, most_rows=5).count() == 0 and spectra.split_at_gaps(f, 72, most_rows=5).count() == 0
