"""Operators on small tables whose results are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tidemark.operators import cregress, field, profile, spectra


def test_collinear_predictors_share_the_coefficient(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((50, 2))
    rows = [(float(2 * a - b), float(2 * b + a), float(a), float(b), float(3 * a), float(3 * b)) for a, b in x]  # y = (2 + i) x
    df = spark.createDataFrame(rows, "yu double, yv double, au double, av double, bu double, bv double")
    fit = cregress.least_squares(cregress.gram(df, ("yu", "yv"), {"a": ("au", "av"), "b": ("bu", "bv")}), ["a", "b"]).first()
    z = x[:, 0] + 1j * x[:, 1]
    z = z - z.mean()
    want = np.linalg.lstsq(np.stack([z, 3 * z], axis=1), (2 + 1j) * z, rcond=None)[0]
    assert np.allclose([fit.c_a_re + 1j * fit.c_a_im, fit.c_b_re + 1j * fit.c_b_im], want, atol=1e-6)
    one = cregress.least_squares(cregress.gram(df, ("yu", "yv"), {"a": ("au", "av"), "z": ("au", "av")}).withColumns({f"g_{k}_re": F.lit(0.0) for k in ("z_z", "z_y", "a_z", "z_a")} | {f"g_{k}_im": F.lit(0.0) for k in ("z_y", "a_z", "z_a")}), ["a", "z"]).first()
    assert (one.c_a_re, one.c_a_im) == pytest.approx((2, 1)) and one.c_z_re == 0


def test_interannual_error_is_over_yearly_profiles(spark):
    rows = [("2020-02-01", 1.1, 1.0), ("2020-02-03", 1.2, 3.0), ("2021-01-05", 1.15, 6.0), ("2022-03-05", 1.2, None), ("2020-05-01", 1.1, 9.0)]
    df = spark.createDataFrame(rows, "day string, lat double, u double").withColumn("ts", F.to_timestamp("day"))
    got = {r.season: (r.iy, r.se, r.n_years) for r in profile.interannual_error(df, "u").collect()}
    assert got[1][0] == 4 and got[1][1] == pytest.approx(np.std([2.0, 6.0], ddof=1) / np.sqrt(2)) and got[1][2] == 2
    assert got[2] == (4, None, 1)
    assert {r.season: r.u for r in profile.seasonal_profile(df, "u").collect()} == {1: pytest.approx(10 / 3), 2: 9.0}


def test_products_at_points_leaves_others_alone(spark):
    axis = [(t, y, x) for t in (0, 60) for y in (0.0, 1.0) for x in (0.0, 1.0)]
    rows = [("a", t, y, x, float(t), y + x) for t, y, x in axis] + [("b", t, y, x, 1.0, 2.0) for t, y, x in axis[1:]]
    grid_rows = spark.createDataFrame(rows, "product string, s int, lat double, lon double, u double, v double").withColumn("time", F.timestamp_seconds("s")).drop("s")
    points = spark.createDataFrame([(1, 30, 0.5, 0.25), (2, 30, 5.0, 0.0)], "id int, s int, lat double, lon double").withColumn("ts", F.timestamp_seconds("s"))
    grid = {"time": (0.0, 60.0, 2), "lat": (0.0, 1.0, 2), "lon": (0.0, 1.0, 2)}
    got = {r.id: r for r in field.products_at_points(points, grid_rows, ["a", "b"], grid).collect()}
    assert (got[1].mapped_a_u, got[1].mapped_a_v) == (30.0, 0.75) and got[1].mapped_b_u is None
    assert got[2].mapped_a_u is None and got[2].mapped_b_v is None


def test_coherence_has_no_value_at_frequency_zero(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), rng.standard_normal(8).tolist()) for i in range(6)]
    df = spark.createDataFrame(rows, "chunk int, a array<double>, b array<double>")
    got = {r.k: r.coherence for r in spectra.coherence(spectra.cross_spectra(df, ["chunk"], "a", "b", 8)).collect()}
    fa, fb = (np.fft.rfft(np.array([r[i] for r in rows]) - np.array([r[i] for r in rows]).mean(1, keepdims=True)) for i in (1, 2))
    want = np.abs((fa * fb.conj()).mean(0)) ** 2 / ((np.abs(fa) ** 2).mean(0) * (np.abs(fb) ** 2).mean(0))
    assert got[0] is None and all(got[k] == pytest.approx(want[k]) for k in range(1, 5))


def test_queries_without_the_document_operators(monkeypatch):
    monkeypatch.setattr(__spark_entry__, "_llm", lambda: (None, None))
    names = set(__spark_entry__.queries())
    assert __spark_entry__.FLAGSHIP in names and set(__spark_entry__.oracle_sql()) <= names
