"""A surface fitted on a sample and settled by the rows near it is that of all rows, in a few jobs."""

import numpy as np
import pytest

from tidemark.operators import quantreg


def table(spark, n):
    rng = np.random.default_rng(11)
    lead, a, b = rng.choice([2.0, 6.0], n), rng.integers(0, 97, n) / 97.0, 4 + 3 * rng.random(n)
    y = np.abs(rng.normal(size=n)) * (1 + 5 * a) * np.where(lead > 4, 3, 1) + b
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in (lead, y, a, b)), strict=True)), "lead_h double, error_km double, diff_init double, lat_init double")
    return df, {k: (y[lead == k - 2], np.stack([np.ones(n), a, b], axis=1)[lead == k - 2]) for k in (4.0, 8.0)}


def loss(c, y, x, q):
    left = y - x @ np.asarray(c)
    return np.maximum(q * left, (q - 1) * left).sum()


def jobs(spark, made):
    spark.sparkContext.setJobGroup("fit", "fit")
    try:
        got = made()
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_jobs(spark):
    df, _ = table(spark, 500)
    _, n = jobs(spark, lambda: quantreg.surface(df, bins=3))
    assert n < 20


@pytest.mark.parametrize("sample", [40, 500, 10_000])
def test_same_plane_as_of_all_rows(spark, sample):
    df, plain = table(spark, 6000)
    got = [r for r in quantreg.surface(df, bins=3, quantiles=(0.1, 0.5, 0.9), sample=sample).collect() if r.b0 is not None]
    assert len(got) == 6
    for r in got:
        y, x = plain[r.lead_h]
        best = loss(quantreg.best_plane(x, y, r.q, 200), y, x, r.q)
        assert loss((r.b0, r.b_speed, r.b_lat), y, x, r.q) <= best * (1 + 1e-7)


def test_bins_of_two_rows_repeated_have_no_plane(spark):
    rows = [(2.0, 1.0, 0.5, 5.0), (2.0, 2.0, 0.25, 6.0)] * 300 + [(6.0, float(i), i / 7, 5.0) for i in range(5)]
    df = spark.createDataFrame(rows, "lead_h double, error_km double, diff_init double, lat_init double")
    for sample in (50, 10_000):
        got = {r.lead_h: r.b0 for r in quantreg.surface(df, bins=2, quantiles=(0.5,), sample=sample).collect()}
        assert got[4.0] is None and got[8.0] is not None
