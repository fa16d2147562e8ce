"""Fourier transforms of array columns, in any length, by numpy's mixed-radix routine on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SERIES = T.ArrayType(T.DoubleType())
_COMPLEX = T.StructType([T.StructField("re", _SERIES), T.StructField("im", _SERIES)])


def _by_length(columns: list[pd.Series], f: Callable[..., tuple[np.ndarray, ...]], n_out: int) -> list[list]:
    """Apply ``f`` to stacks of arrays of one length each; rows with a null array, or with an empty one, give null."""
    out: list[list] = [[None] * len(columns[0]) for _ in range(n_out)]
    lengths = [-1 if any(c is None for c in row) else len(row[0]) for row in zip(*columns, strict=True)]
    for n in sorted(set(lengths) - {-1, 0}):
        at = [i for i, m in enumerate(lengths) if m == n]
        made = f(*[np.array([c.iloc[i] for i in at], dtype=float) for c in columns])
        for o, m in zip(out, made, strict=True):
            for i, row in zip(at, m, strict=True):
                o[i] = row
    return out


@F.pandas_udf(_COMPLEX)
def _transform(re: pd.Series, im: pd.Series) -> pd.DataFrame:
    def f(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.fft.fft(a + 1j * b, axis=1)
        return x.real, x.imag

    a, b = _by_length([re, im], f, 2)
    return pd.DataFrame({"re": a, "im": b})


def transform(re: Column, im: Column | None = None) -> Column:
    """(re[], im[]) of the sums over j of x_j exp(-2 pi i j k / n), k from 0 to n - 1, of the series re + i im."""
    return _transform(re, F.transform(re, lambda _: F.lit(0.0)) if im is None else im)


def _lagged(*parts: np.ndarray) -> np.ndarray:
    """Sums over j of x_j x_{j + lag}, over all parts, for each lag from 0 to n - 1: the inverse transform of the padded power."""
    n = parts[0].shape[1]
    power = sum(np.abs(np.fft.rfft(p, 2 * n, axis=1)) ** 2 for p in parts)
    return np.fft.irfft(power, 2 * n, axis=1)[:, :n]


@F.pandas_udf(_SERIES)
def lagged_products(u: pd.Series, v: pd.Series) -> pd.Series:
    """Sums over j of u_j u_{j + lag} + v_j v_{j + lag}, for each lag from 0."""
    return pd.Series(_by_length([u, v], lambda a, b: (_lagged(a, b),), 1)[0])


#: Overlaps of at most so many values are centred and multiplied out, as their variance may be tiny beside that of the series.
SHORT = 32


def _pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (x - x.mean(axis=1, keepdims=True) for x in (a, b))
    size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.where(size > 0, (a * b).sum(axis=1) / np.where(size > 0, size, 1), np.nan)


def _overlaps(x: np.ndarray) -> tuple[np.ndarray]:
    n = x.shape[1]
    x = x - x.mean(axis=1, keepdims=True)
    ahead = np.cumsum(np.stack([x, x * x]), axis=2)
    left = ahead[:, :, ::-1]
    right = ahead[:, :, -1:] - np.concatenate([np.zeros((2, len(x), 1)), ahead[:, :, :-1]], axis=2)
    count = np.arange(n, 0, -1.0)
    size = [count * s[1] - s[0] ** 2 for s in (left, right)]
    known = (size[0] > 1e-13 * count * left[1]) & (size[1] > 1e-13 * count * right[1])
    with np.errstate(invalid="ignore", divide="ignore"):
        r = (count * _lagged(x) - left[0] * right[0]) / np.sqrt(size[0] * size[1])
    r = np.where(known, np.clip(r, -1, 1), np.nan)
    for lag in range(max(0, n - SHORT), n):
        r[:, lag] = _pearson(x[:, : n - lag], x[:, lag:])
    return (r,)


@F.pandas_udf(_SERIES)
def overlap_correlations(x: pd.Series) -> pd.Series:
    """Pearson correlation of x_0 .. x_{n - lag - 1} with x_lag .. x_{n - 1}, for each lag from 0; null where either part is constant."""
    return pd.Series(_by_length([x], _overlaps, 1)[0])
