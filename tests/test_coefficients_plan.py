"""Coefficients at any lead against plain loops; segments are found by compiled cases and an equality."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import resample


def test_against_plain_loops(spark):
    rng = random.Random(2)
    leads = {"a": [4.0, 8.0, 12.0, 30.0], "b": [1.0, 8.0], "c": [5.0], "d": [12.0, 13.0, 14.5]}
    rows = [(k, x, rng.random(), rng.random()) for k, xs in leads.items() for x in xs]
    points = [(i, p) for i, p in enumerate([-3.0, 0.0, 1.0, 4.0, 7.99, 8.0, 12.0, 12.5, 13.0, 14.5, 29.0, 30.0, 99.0, None])]
    surface, at = spark.createDataFrame(rows, "q string, lead_h double, b0 double, b1 double"), spark.createDataFrame(points, "i int, lead_h double")
    made = resample.coefficients_at(at, surface, values=["b0", "b1"])
    got = {(r.i, r.q): (r.b0, r.b1) for r in made.collect()}
    want = {}
    for i, p in points:
        for k, xs in leads.items():
            if p is not None and len(xs) > 1:
                n = [r[1:] for r in rows if r[0] == k]
                j = min(max(sum(x <= p for x in xs) - 1, 0), len(xs) - 2)
                want[i, k] = tuple(n[j][v] + (n[j + 1][v] - n[j][v]) * (p - xs[j]) / (xs[j + 1] - xs[j]) for v in (1, 2))
    assert set(got) == set(want) and len(want) == 39
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12)
    assert resample.coefficients_at(at, surface.where(F.col("q") == "c")).count() == 0


def test_nothing_is_interpreted_for_each_point(spark):
    surface = spark.createDataFrame([(q, float(x), 1.0 * x) for q in (0.3, 0.9) for x in range(4, 196, 4)], "q double, lead_h double, b0 double")
    plan = resample.coefficients_at(spark.range(10).select(F.col("id") / 3.0).toDF("lead_h"), surface)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
