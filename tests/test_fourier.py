"""Transforms of array columns and the spectra made of them against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import fourier
from tidemark.operators import spectra

LENGTHS = (1, 2, 3, 7, 30, 42, 64, 97, 500)


def series(seed):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(size=n).cumsum().tolist(), rng.normal(size=n).tolist()) for i, n in enumerate(LENGTHS)]


def test_transform_and_lagged_products(spark):
    rows = series(1)
    df = spark.createDataFrame([*rows, (99, None, None), (98, [], [])], "id int, u array<double>, v array<double>").repartition(2)
    got = {r.id: r for r in df.select("id", fourier.transform(F.col("u"), F.col("v")).alias("x"), fourier.lagged_products("u", "v").alias("p")).collect()}
    for i, u, v in rows:
        n, z = len(u), np.array(u) + 1j * np.array(v)
        direct = np.array([(z * np.exp(-2j * np.pi * k * np.arange(n) / n)).sum() for k in range(n)])
        np.testing.assert_allclose(np.array(got[i].x.re) + 1j * np.array(got[i].x.im), direct, atol=1e-9)
        np.testing.assert_allclose(got[i].p, [np.dot(u[: n - k], u[k:]) + np.dot(v[: n - k], v[k:]) for k in range(n)], atol=1e-9 * (1 + np.dot(u, u)))
    assert got[99].p is None and got[98].p is None


def test_overlap_correlations(spark):
    rows = [*series(2), (50, [1e6] * 40 + [1e6 + 1e-3, 1e6], []), (51, [2.0] * 80, []), (52, [0.0] * 40 + np.arange(40.0).tolist(), [])]
    df = spark.createDataFrame(rows, "id int, u array<double>, v array<double>")
    got = {r.id: r.r for r in df.select("id", fourier.overlap_correlations("u").alias("r")).collect()}
    for i, u, _ in rows:
        for k, r in enumerate(got[i]):
            a, b = np.array(u[: len(u) - k]), np.array(u[k:])
            if np.ptp(a) == 0 or np.ptp(b) == 0:
                assert r is None
            else:
                assert abs(r - np.corrcoef(a, b)[0, 1]) < 1e-6


@pytest.mark.parametrize("n", [42, 43, 4096])
def test_spectra(spark, n):
    rng = np.random.default_rng(n)
    u, v = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame([(1, u.tolist(), v.tolist())], "id int, u array<double>, v array<double>")
    du, dv, j = u - u.mean(), v - v.mean(), np.arange(n)
    some = [1, 2, n // 3, (n + 1) // 2 - 1]

    def at(x, k):
        return (x * np.exp(-2j * np.pi * k * j / n)).sum()

    power = {r.k: r.power for r in spectra.periodogram(df, ["id"], n, 6.0).collect()}
    assert sorted(power) == list(range(1, (n + 1) // 2))
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * j / n)
    dense = {r.k: r.power for r in spectra.welch(df, ["id"], "u", n, 6.0).collect()}
    cross = {r.k: r for r in spectra.cross_spectra(df, ["id"], "u", "v", n).collect()}
    assert sorted(dense) == sorted(cross) == list(range(n // 2 + 1))
    for k in some:
        assert abs(power[k] - 2 / (6 * n) * abs(at(du + 1j * dv, k)) ** 2) < 1e-9
        assert abs(dense[k] - 2 * abs(at(du * hann, k)) ** 2 / (6 * (hann**2).sum())) < 1e-9
        z = at(du, k) * np.conj(at(dv, k))
        np.testing.assert_allclose([cross[k].cross_re, cross[k].cross_im, cross[k].auto_a], [z.real, z.imag, abs(at(du, k)) ** 2], rtol=1e-9, atol=1e-7)
    acf = [r.r for r in spectra.vector_acf(df, ["id"]).orderBy("lag").collect()]
    assert len(acf) == n - 1 and acf[0] == pytest.approx(1)
    assert acf[5] == pytest.approx((np.dot(du[:-5], du[5:]) + np.dot(dv[:-5], dv[5:])) / (np.dot(du, du) + np.dot(dv, dv)), abs=1e-9)


def test_matrix_round_trip(spark):
    rows = spark.createDataFrame([(c, lag, c + lag / 8.0) for c in range(3) for lag in range(4)], "id int, lag int, r double")
    wide = spectra.to_matrix(rows, ["id"], [0, 1, 2, 3])
    assert wide.columns == ["id", "0", "1", "2", "3"]
    assert sorted(map(tuple, spectra.from_matrix(wide, ["id"], [0, 1, 2, 3]).collect())) == sorted(map(tuple, rows.collect()))
