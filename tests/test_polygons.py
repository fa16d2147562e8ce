"""Fixes in many polygons against the plain test, and daily counts of buoys that leave and come back."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import polygons, selection

RING = "poly_id long, ring array<struct<lon: double, lat: double>>"


def shapes(seed, n):
    """Rings of all sizes: smaller than a cell, over many cells, with sides on cell lines, crossing themselves."""
    rng = random.Random(seed)
    out = [(0, [(-162.0, 5.0), (-161.0, 5.0), (-161.0, 6.0), (-162.0, 6.0)]), (1, [(-164.0, 4.0), (-160.0, 8.0), (-160.0, 4.0), (-164.0, 8.0)]), (2, [(-161.0, 5.0), (-161.0, 6.0)]), (3, [])]
    for i in range(4, n):
        x, y, size = rng.uniform(-164, -160), rng.uniform(4, 8), rng.choice([0.01, 0.1, 0.7, 2.0])
        out.append((i, [(x + rng.uniform(-size, size), y + rng.uniform(-size, size)) for _ in range(rng.randint(3, 9))]))
    return out


@pytest.mark.parametrize("level", [0, 3, 5])
def test_same_as_the_plain_test(spark, level):
    rng = random.Random(7)
    rows = [(i, rng.choice([rng.uniform(-164.5, -159.5), round(rng.uniform(-164, -160) * 8) / 8]), rng.choice([rng.uniform(3.5, 8.5), round(rng.uniform(4, 8) * 8) / 8])) for i in range(1500)] + [(9000, None, 5.0), (9001, -161.0, None)]
    fixes = spark.createDataFrame(rows, "fix_id long, lon double, lat double")
    rings = shapes(level, 40)
    got = polygons.in_polygons(fixes, spark.createDataFrame(rings, RING), level).select("poly_id", "fix_id").collect()
    plain = fixes.select("fix_id", *[geo.in_polygon(F.col("lon"), F.col("lat"), ring).alias(str(p)) for p, ring in rings if len(ring) > 2]).collect()
    want = {(p, r.fix_id) for r in plain for p, ring in rings if len(ring) > 2 and r[str(p)]}
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 1000


def test_cells_tell_most_fixes(spark):
    ring = [(-164.0 + 0.001, 4.0), (-160.0, 4.0), (-160.0, 8.0), (-164.0, 8.0)]
    cells = polygons.cover(spark.createDataFrame([(1, ring)], RING), 4)
    count = {r.boundary: r["count"] for r in cells.groupBy("boundary").count().collect()}
    assert count[False] > 3000 and count[True] < 600


def test_buoys_that_come_back(spark):
    start = datetime(2024, 1, 1, 12)
    seen = {1: [0, 1, 2, 9, 10], 2: [1, 3, 5, 8], 3: [4], 4: [10]}
    rows = [(b, start + timedelta(days=d, hours=h)) for b, days in seen.items() for d in days for h in (0, 3)] + [(5, None)]
    got = [r.active for r in selection.active_with_reentry(spark.createDataFrame(rows, "buoy_id long, ts timestamp"), 3).orderBy("day").collect()]
    spans = [(0, 2), (9, 10), (1, 5), (8, 8), (4, 4), (10, 10)]
    assert got == [sum(a <= d <= b for a, b in spans) for d in range(11)]
    assert selection.active_with_reentry(spark.createDataFrame([], "buoy_id long, ts timestamp")).count() == 0
