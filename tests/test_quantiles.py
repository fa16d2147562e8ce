"""Quantiles by selection against numpy, on groups of all shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles

QS = [0.0, 0.025, 0.3, 0.5, 0.9, 1.0]


@pytest.mark.parametrize(("few", "bins"), [(1, 4), (10, 16), (100_000, 1024)])
def test_against_numpy(spark, few, bins):
    rng = np.random.default_rng(1)
    groups = {"one": [3.0], "two": [1.0, 2.0], "equal": [5.0] * 300, "even": list(np.arange(1000.0)), "far": [*rng.normal(size=500), 1e12, -1e9], "ties": list(rng.integers(0, 4, 700) * 1.0), "tail": list(10.0 ** rng.uniform(-9, 9, 400)), None: [2.0, 4.0, 9.0]}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("even", None), ("none", None), ("even", float("nan"))]
    got = {r.g: r for r in quantiles.select(spark.createDataFrame(rows, "g string, x double").repartition(7), ["g"], "x", QS, few, bins).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g].n == len(xs)
        np.testing.assert_allclose(got[g].quantiles, np.quantile(xs, QS), rtol=1e-12, atol=1e-12)


def test_one_large_group_in_small_tasks(spark):
    n = 3_000_000
    big = spark.range(n, numPartitions=8).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("x"))
    got = quantiles.select(big, [], "x", [0.1, 0.98], few=2000, bins=256)
    want = np.quantile(big.toPandas()["x"], [0.1, 0.98])
    np.testing.assert_allclose(got.first().quantiles, want, rtol=1e-12)
    assert got.first().n == n


def test_empty(spark):
    assert quantiles.select(spark.createDataFrame([], "g string, x double"), ["g"], "x", QS).count() == 0
