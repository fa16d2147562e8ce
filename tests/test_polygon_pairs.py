"""Pairs of fixes and polygons leave the tasks that find them; groups of any size give the same pairs and runs."""

import random
from datetime import datetime, timedelta

import pytest

from tests.test_polygons import RING, shapes
from tidemark.operators import polygons

STORE = "buoy_id long, fix_id long, ts timestamp, lon double, lat double"


def in_ring(x, y, ring):
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def walks(seed, buoys, fixes):
    """Tracks of small steps, some fixes without a position, two at one time."""
    rng, start, out = random.Random(seed), datetime(2024, 1, 1), []
    for b in range(buoys):
        x, y = rng.uniform(-164, -160), rng.uniform(4, 8)
        for i in range(fixes):
            x, y = x + rng.uniform(-0.2, 0.2), y + rng.uniform(-0.2, 0.2)
            out.append((b, b * 1000 + i, start + timedelta(hours=i // 2), None if rng.random() < 0.03 else x, y))
    return out


def stays(rows, rings, least):
    out = []
    for p, ring in rings:
        run = []
        for b, i, _, x, y in [*rows, (None, None, None, None, None)]:
            if len(ring) > 2 and x is not None and (not run or run[0][0] == b) and in_ring(x, y, ring):
                run.append((b, i))
                continue
            out += [(p, *r, run[0][1], len(run)) for r in run if len(run) >= least]
            run = [(b, i)] if len(ring) > 2 and x is not None and in_ring(x, y, ring) else []
    return sorted(out)


@pytest.mark.parametrize(("most_fixes", "most_sides"), [(250_000, 2_000_000), (150, 40)])
def test_runs_and_pairs_in_groups_of_any_size(spark, monkeypatch, most_fixes, most_sides):
    monkeypatch.setattr(polygons, "FIXES", most_fixes)
    monkeypatch.setattr(polygons, "SIDES", most_sides)
    rng = random.Random(3)
    many = [(-162 + rng.uniform(-1, 1), 6 + rng.uniform(-1, 1)) for _ in range(300)]  # a ring of several pieces that crosses itself
    rows, rings = walks(5, 12, 60), [*shapes(2, 30), (500, many)]
    fixes, shaped = spark.createDataFrame(rows, STORE), spark.createDataFrame(rings, RING)
    want = stays(rows, rings, 2)
    got = polygons.runs_in_polygons(fixes, shaped).select("poly_id", "buoy_id", "fix_id", "run", "run_len").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 300
    pairs = polygons.in_polygons(fixes, shaped, columns=["fix_id"]).select("poly_id", "fix_id").collect()
    assert sorted(map(tuple, pairs)) == [(p, i) for p, _, i, _, _ in stays(rows, rings, 1)]


def test_empty_tables(spark):
    none, ring = spark.createDataFrame([], STORE), [(1, [(-162.0, 5.0), (-161.0, 5.0), (-161.0, 6.0)])]
    one = spark.createDataFrame(walks(1, 1, 3), STORE)
    for fixes, shaped in ((none, spark.createDataFrame(ring, RING)), (one, spark.createDataFrame([], RING))):
        assert polygons.in_polygons(fixes, shaped).count() == polygons.runs_in_polygons(fixes, shaped).count() == 0


@pytest.mark.parametrize("operator", [polygons.in_polygons, polygons.runs_in_polygons])
def test_pairs_are_not_shuffled(spark, operator):
    ring = [(-162.0, 5.0), (-161.0, 5.2), (-161.1, 6.1), (-162.3, 6.0)]
    rings = spark.createDataFrame([(p, [(x + p / 1000, y) for x, y in ring]) for p in range(250)], RING)
    rows = [(i % 10, i, datetime(2024, 1, 1) + timedelta(hours=i), -161.7 + i / 1000, 5.4 + i / 1000) for i in range(250)]
    fixes = spark.createDataFrame(rows, STORE)
    jvm, doubles = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def listed():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, doubles, jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    before = set(listed())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert operator(fixes, rings).count() == 250 * 250
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(n for k, n in listed().items() if k not in before) < 10_000
