"""Segments, chunks, autocorrelation, spectra and coherence of velocity series. Series are arrays; transforms of whole arrays are those of functions.fourier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import fourier
from tidemark.operators.resample import regular
from tidemark.operators.scan import over_track, running_sum


def split_at_gaps(fixes: DataFrame, most_hours: float, most_rows: int | None = None) -> DataFrame:
    """Fixes with their segment; a gap longer than ``most_hours`` starts a new one, segments of one fix go.

    A fix is alone in its segment if a gap, or the end of the track, is on each side of it. Tracks of over
    ``most_rows`` fixes are cut into ranges of time (scan.over_track, scan.running_sum).
    """
    most = int(most_hours * 3.6e9)
    us = F.unix_micros(F.col("ts").cast("timestamp"))

    def gaps(w: WindowSpec) -> dict[str, Column]:
        back, ahead = us - F.lag(us).over(w), F.lead(us).over(w) - us
        ends = F.lead(F.lit(1)).over(w).isNull() | F.coalesce(ahead > most, F.lit(False))
        return {"_new": F.coalesce(back > most, F.lit(False)).cast("int"), "_first": F.lag(F.lit(1)).over(w).isNull(), "_ends": ends}

    out = running_sum(over_track(fixes, gaps, 1, 1, most_rows), "_new", "segment", most_rows)
    return out.where(~(F.col("_ends") & (F.col("_first") | (F.col("_new") == 1)))).drop("_new", "_first", "_ends")


def chunks(segments: DataFrame, step_h: float, days: float) -> DataFrame:
    """(buoy_id, segment, chunk_no, start_us, u[], v[]): whole chunks of equal length of the resampled series."""
    length = days * 24 / step_h
    if length != int(length):
        raise ValueError("days must be a whole number of steps")
    length = int(length)
    us = segments.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    even = regular(us.dropna(subset=["u", "v"]), ["buoy_id", "segment"], "us", ["u", "v"], int(step_h * 3.6e9))
    span = (F.max("us").over(Window.partitionBy("buoy_id", "segment")) - F.min("us").over(Window.partitionBy("buoy_id", "segment"))) / 8.64e10
    even = even.withColumns({"chunk_no": F.floor(F.col("i") / length), "_span": span}).where(F.col("_span") >= days - step_h / 24)
    made = even.groupBy("buoy_id", "segment", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("i", "us", "u", "v"))).alias("x"))
    made = made.where(F.size("x") == length)
    return made.select("buoy_id", "segment", "chunk_no", F.col("x")[0]["us"].alias("start_us"), F.col("x.u").alias("u"), F.col("x.v").alias("v"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def _centred(a: Column) -> Column:
    mean = _sum(a) / F.size(a)
    return F.transform(a, lambda x: x - mean)


def vector_acf(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lag, r): biased vector autocorrelation, lags 0..N-2; 1 at lag 0 (I3). All lags by one transform and its inverse."""
    c = chunked.withColumns({"_u": _centred(F.col("u")), "_v": _centred(F.col("v"))}).withColumn("_p", _dot(F.col("_u"), F.col("_u")) + _dot(F.col("_v"), F.col("_v")))
    lags = F.slice(fourier.lagged_products("_u", "_v"), F.lit(1), F.size("u") - 1)
    return c.select(*keys, "_p", F.posexplode(lags).alias("lag", "_s")).select(*keys, "lag", F.try_divide(F.col("_s"), F.col("_p")).alias("r"))


def scalar_acf(chunked: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lag, r_u, r_v, r_speed): Pearson correlation of the overlapping parts, null where one is constant (I4)."""
    parts = {"u": F.col("u"), "v": F.col("v"), "speed": F.zip_with("u", "v", F.hypot)}
    each = chunked.select(*keys, *[F.slice(fourier.overlap_correlations(x), F.lit(1), F.size("u") - 1).alias(f"r_{n}") for n, x in parts.items()])
    rows = each.select(*keys, F.posexplode(F.arrays_zip(*[f"r_{n}" for n in parts])).alias("lag", "_r"))
    return rows.select(*keys, "lag", *[F.col(f"_r.r_{n}").alias(f"r_{n}") for n in parts])


def acf_job(legs: DataFrame, gap_h: float = 72, step_h: float = 4, days: float = 7) -> DataFrame:
    """(buoy_id, segment, chunk_no, start_us, lag, lag_h, r) of all tracks."""
    made = chunks(split_at_gaps(legs, gap_h), step_h, days)
    return vector_acf(made, ["buoy_id", "segment", "chunk_no", "start_us"]).withColumn("lag_h", F.col("lag") * step_h)


def to_matrix(acf: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """A column for each lag."""
    return acf.groupBy(*keys).pivot("lag", lags).agg(F.first("r"))


def from_matrix(matrix: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """Back to rows."""
    return matrix.unpivot(keys, [str(k) for k in lags], "lag", "r").withColumn("lag", F.col("lag").cast("int"))


def _spectrum(df: DataFrame, keys: list[str], names: list[str], frequencies: Column) -> DataFrame:
    """(keys, k, name_re, name_im of each name) at ``frequencies``, from a transform of the real series in the columns ``names``."""
    made = df.select(*keys, *[fourier.transform(F.col(x)).alias(x) for x in names], F.explode(frequencies).alias("k"))
    return made.select(*keys, "k", *[F.get(F.col(f"{x}.{p}"), F.col("k")).alias(f"{x}_{p}") for x in names for p in ("re", "im")])


def periodogram(chunked: DataFrame, keys: list[str], n: int, rate: float) -> DataFrame:
    """(keys, k, power) of u + i v: 2/(rate N) |X|^2 at positive frequencies without the Nyquist one."""
    x = fourier.transform(_centred(F.col("u")), _centred(F.col("v")))
    power = F.transform(F.arrays_zip(x["re"].alias("re"), x["im"].alias("im")), lambda z: 2 / (rate * n) * (z["re"] * z["re"] + z["im"] * z["im"]))
    kept = F.slice(F.transform(power, lambda p, k: F.struct(k.alias("k"), p.alias("power"))), 2, (n + 1) // 2 - 1)
    return chunked.select(*keys, F.inline(kept))


def welch(chunked: DataFrame, keys: list[str], column: str, n: int, rate: float) -> DataFrame:
    """(keys, k, power): one-sided density under a periodic Hann window."""
    window = [0.5 - 0.5 * math.cos(2 * math.pi * j / n) for j in range(n)]
    weighted = F.transform(_centred(F.col(column)), lambda x, j: x * (0.5 - 0.5 * F.cos(2 * math.pi * j / n)))
    t = _spectrum(chunked.select(*keys, weighted.alias("x")), keys, ["x"], F.sequence(F.lit(0), F.lit(n // 2)))
    twice = F.when((F.col("k") == 0) | (F.lit(n % 2 == 0) & (F.col("k") == n // 2)), 1.0).otherwise(2.0)
    power = (F.col("x_re") * F.col("x_re") + F.col("x_im") * F.col("x_im")) * twice / (rate * sum(w * w for w in window))
    return t.select(*keys, "k", power.alias("power"))


def mean_spectrum(power: DataFrame, n: int, rate_per_day: float) -> DataFrame:
    """(k, per_day, power): mean over chunks by frequency."""
    return power.groupBy("k").agg(F.avg("power").alias("power")).withColumn("per_day", F.col("k") * rate_per_day / n)


def cross_spectra(paired: DataFrame, keys: list[str], a: str, b: str, n: int) -> DataFrame:
    """(keys, k, auto_a, auto_b, cross_re, cross_im) of two array columns, k = 0..N/2."""
    t = _spectrum(paired.withColumns({a: _centred(F.col(a)), b: _centred(F.col(b))}), keys, [a, b], F.sequence(F.lit(0), F.lit(n // 2)))
    ar, ai, br, bi = F.col(f"{a}_re"), F.col(f"{a}_im"), F.col(f"{b}_re"), F.col(f"{b}_im")
    return t.select(*keys, "k", (ar * ar + ai * ai).alias("auto_a"), (br * br + bi * bi).alias("auto_b"), (ar * br + ai * bi).alias("cross_re"), (ai * br - ar * bi).alias("cross_im"))


def coherence(spectra: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(k, coherence): |mean cross|^2 / (mean auto a * mean auto b) (I13); null for k = 0, as means are removed."""
    keys = keys or []
    m = spectra.groupBy(*keys, "k").agg(*[F.avg(c).alias(c) for c in ("auto_a", "auto_b", "cross_re", "cross_im")])
    top = F.col("cross_re") * F.col("cross_re") + F.col("cross_im") * F.col("cross_im")
    return m.select(*keys, "k", F.when(F.col("k") > 0, F.try_divide(top, F.col("auto_a") * F.col("auto_b"))).alias("coherence"))
