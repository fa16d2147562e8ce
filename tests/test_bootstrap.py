"""Draws with replacement really differ between resamples, and bands have a width."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import bootstrap


def test_draws_repeat_numbers(spark):
    rows = bootstrap.draws(spark, 400, 15).toPandas()
    distinct = rows.groupby("resample").idx.nunique()
    # of 15 draws with replacement, 15 * (1 - (14 / 15) ** 15) = 9.67 numbers are expected
    assert 9.2 < distinct.mean() < 10.2 and distinct.min() < 15
    assert rows.idx.between(0, 14).all() and rows.idx.value_counts(normalize=True).between(0.055, 0.08).all()


def test_band_is_as_wide_as_theory_says(spark):
    values = np.random.default_rng(5).standard_normal(60)
    rows = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(values)], "block long, k int, x double")
    got = bootstrap.over_blocks(rows, "block", ["k"], "x", bootstrap.draws(spark, 800, 60)).first()
    width = 2 * 1.96 * values.std() / np.sqrt(60)
    assert abs(got["mean"] - values.mean()) < 0.03 and 0.8 * width < got["high"] - got["low"] < 1.2 * width


def test_cell_error_is_above_zero(spark):
    rows = spark.range(200).select("id", (F.col("id") % 2).alias("cell"), F.sin("id").alias("x"))
    assert all(0.05 < r["error"] < 0.25 for r in bootstrap.cell_error(rows, ["cell"], "x", "id", 200).collect())


def test_cell_error_is_as_theory_says(spark):
    values = np.random.default_rng(7).standard_normal(900)
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(values)] + [(0, 5000, None)], "cell int, id long, x double")
    got = bootstrap.cell_error(rows, ["cell"], "x", "id").first()
    assert abs(got["mean"] - values.mean()) < 1e-12
    assert abs(got["error"] - 1.645 * values.std() / 30) < 0.15 * 1.645 / 30


def test_blocks_of_time(spark):
    rows = spark.sql("SELECT id, unix_micros(timestamp'2024-01-03 06:00:00' + make_interval(0, 0, 0, cast(if(id < 11, id, id + 700) as int))) AS us FROM range(21) UNION ALL SELECT 99, null")
    blocks, n = bootstrap.numbered_blocks(rows, "us", 5)
    # the empty blocks of the two years between have no number
    assert n == 6 and sorted((r["block"] if r["block"] is not None else -1, r["count"]) for r in blocks.groupBy("block").count().collect()) == [(-1, 1), (0, 5), (1, 5), (2, 1), (3, 4), (4, 5), (5, 1)]
    assert bootstrap.numbered_blocks(rows.where("false"), "us")[1] == 1


def test_no_coherence_at_frequency_zero(spark):
    rows = spark.createDataFrame([(b, k, 1.0 + b, 2.0, 0.5 * b, 0.1) for b in range(4) for k in range(3)], "block long, k int, auto_a double, auto_b double, cross_re double, cross_im double")
    got = {r.k: r for r in bootstrap.coherence_band(rows, "block", bootstrap.draws(spark, 50, 4)).collect()}
    assert got[0]["mean"] is None and got[0].low is None and got[0].high is None and 0 < got[1].low < got[1].high


def test_cell_error_of_many_cells_and_null_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 3, "a" if i % 2 else None, i, float(i % 7)) for i in range(300)] + [(0, "a", None, 1e9), (0, "a", 7, None)], "i int, t string, id long, x double")
    got = {(r.i, r.t): r for r in bootstrap.cell_error(rows, ["i", "t"], "x", "id", 100).collect()}
    assert len(got) == 6
    for (i, t), r in got.items():
        x = np.array([float(j % 7) for j in range(300) if j % 3 == i and (j % 2 == 1) == (t == "a")])
        times = bootstrap._times_drawn(np.array([j for j in range(300) if j % 3 == i and (j % 2 == 1) == (t == "a")]), 100, 1)
        assert abs(r["mean"] - x.mean()) < 1e-12 and abs(r["error"] - (np.quantile((x @ times) / times.sum(axis=0), 0.95) - x.mean())) < 1e-12
