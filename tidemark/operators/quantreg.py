"""Quantile regression of forecast errors by lead bin: fitted on a sample, then settled by the rows near that fit and sums of all others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = tuple(i / 10 for i in range(1, 10))
#: Rows of a bin that one task fits at once; a bin with more is fitted on so many first.
SAMPLE = 100_000
_FIT = "bin int, q double, c0 double, ca double, cb double, near double, distinct int"


def _step(v: np.ndarray, d: np.ndarray) -> float:
    """The longest step along ``d`` that keeps ``v`` positive."""
    down = d < 0
    return float(np.min(-v[down] / d[down], initial=1e20))


def best_plane(x: np.ndarray, y: np.ndarray, q: float, passes: int) -> np.ndarray:
    """Coefficients of the q-quantile of y on the columns of x, by the interior point method of Frisch and Newton.

    Rows may be sums of rows. Of coefficients as good the least are taken where columns are collinear.
    """
    n = len(y)
    scale = float(np.mean(np.abs(y))) or 1.0
    c = -y / scale
    a = np.full(n, 1 - q)
    s = 1 - a
    b = x.T @ a
    p = np.linalg.lstsq(x, c, rcond=1e-12)[0]
    r = c - x @ p
    r += 0.001 * (r == 0)
    z = np.maximum(r, 0) + 1e-12
    w = z - r
    for _ in range(passes):
        if c @ a - p @ b + w.sum() < 1e-10 * n:
            break
        d = 1 / (z / a + w / s)
        r = z - w
        inverse = np.linalg.pinv((x * d[:, None]).T @ x, rcond=1e-14, hermitian=True)
        dp = inverse @ (x.T @ (d * r))
        da = d * (x @ dp - r)
        dz, dw = -z * (1 + da / a), -w * (1 - da / s)
        up, low = min(0.9995 * min(_step(a, da), _step(s, -da)), 1), min(0.9995 * min(_step(w, dw), _step(z, dz)), 1)
        if min(up, low) < 1:
            mu = z @ a + w @ s
            g = (z + low * dz) @ (a + up * da) + (w + low * dw) @ (s - up * da)
            mu = mu * (g / mu) ** 3 / (2 * n)
            dadz, dsdw = da * dz, -da * dw
            xi = mu * (1 / a - 1 / s)
            dp = inverse @ (x.T @ (d * (r + dadz - dsdw - xi)))
            da = d * (x @ dp + xi - r - dadz + dsdw)
            dz, dw = mu / a - z - z * da / a - dadz, mu / s - w + w * da / s - dsdw
            up, low = min(0.9995 * min(_step(a, da), _step(s, -da)), 1), min(0.9995 * min(_step(w, dw), _step(z, dz)), 1)
        a, s, p, w, z = a + up * da, s - up * da, p + low * dp, w + low * dw, z + low * dz
    return -p * scale


def surface(df: DataFrame, y: str = "error_km", a: str = "diff_init", b: str = "lat_init", lead: str = "lead_h", step: float = 4.0, bins: int = 41, quantiles: tuple = QUANTILES, passes: int = 60, sample: int = SAMPLE) -> DataFrame:
    """(lead_h, q, b0, b_speed, b_lat): y's q-quantile as a plane of a and b in each lead bin; nulls for bins too thin.

    A bin of up to ``sample`` rows is fitted whole. Of a larger one a random sample gives a plane and a distance about it; all
    rows farther off count by their sums, those nearer as they are, and the plane is fitted to both. If it has moved
    by less than that distance over the whole extent of a and b, no row changed sides and it is the plane of
    all rows; else the fit is done again about it with twice the distance. ``passes`` bounds the steps of each fit.
    Only coefficients and sums reach the driver; the result is judged by its pinball loss.
    """
    spark = df.sparkSession
    rows = df.select((F.ceil(F.col(lead) / step) - 1).cast("int").alias("bin"), F.col(y).cast("double").alias("y"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    rows = rows.where((F.col("bin") >= 0) & (F.col("bin") < bins)).persist()
    try:
        ends = [f(c).alias(f"{n}{c}") for c in ("a", "b") for f, n in ((F.avg, "m"), (F.stddev, "s"), (F.min, "low_"), (F.max, "high_"))]
        shape = {r["bin"]: r.asDict() for r in rows.groupBy("bin").agg(F.count("*").alias("n"), F.stddev("y").alias("sy"), *ends).where("n >= 3").collect()}
        for r in shape.values():
            r |= {k: r[k] or 1.0 for k in ("sa", "sb", "sy")}

        def standard(k: int, va: np.ndarray, vb: np.ndarray) -> np.ndarray:
            r = shape[k]
            return np.stack([np.ones(len(va)), (va - r["ma"]) / r["sa"], (vb - r["mb"]) / r["sb"]], axis=1)

        def columns(t: pa.Table) -> list[np.ndarray]:
            return [t[c].to_numpy() for c in ("y", "a", "b")]

        def first(t: pa.Table) -> pa.Table:
            k, (v, va, vb) = t["bin"][0].as_py(), columns(t)
            distinct = len(np.unique(np.stack([v, va, vb], axis=1)[:10_000], axis=0))
            distinct = distinct if distinct > 2 else len(np.unique(np.stack([v, va, vb], axis=1), axis=0))
            x, out = standard(k, va, vb), []
            for q in quantiles:
                p = best_plane(x, v, q, passes)
                # wide enough for several errors of the sample's plane, at the corners too
                near = np.quantile(np.abs(v - x @ p), min(1.0, 12 / len(v) ** 0.5))
                out.append((k, q, *map(float, p), float(max(near, 1e-6 * shape[k]["sy"])), min(distinct, 3)))
            return pa.Table.from_pylist([dict(zip(("bin", "q", "c0", "ca", "cb", "near", "distinct"), o, strict=True)) for o in out], schema)

        schema = pa.schema([("bin", pa.int32()), ("q", pa.float64()), *[(c, pa.float64()) for c in ("c0", "ca", "cb", "near")], ("distinct", pa.int32())])
        found, near = {}, {}
        if shape:
            shares = F.broadcast(spark.createDataFrame([(k, min(1.0, sample / r["n"])) for k, r in shape.items()], "bin int, share double"))
            drawn = rows.join(shares, "bin").where((F.col("share") >= 1) | (F.rand(7) < F.col("share"))).drop("share")
            for r in drawn.groupBy("bin").applyInArrow(first, _FIT).collect():
                k = r["bin"]
                if r["distinct"] > 2 or (shape[k]["n"] > sample and rows.where(F.col("bin") == k).select("a", "b", "y").distinct().limit(3).count() > 2):
                    found[k, r["q"]] = np.array([r["c0"], r["ca"], r["cb"]])
                    if shape[k]["n"] > sample:
                        near[k, r["q"]] = r["near"]
        while near:
            planes = spark.createDataFrame([(k, q, *map(float, found[k, q]), d, *[float(shape[k][c]) for c in ("ma", "sa", "mb", "sb")]) for (k, q), d in near.items()], "bin int, q double, c0 double, ca double, cb double, near double, ma double, sa double, mb double, sb double")
            planes = planes.groupBy("bin").agg(F.collect_list(F.struct("q", "c0", "ca", "cb", "near", "ma", "sa", "mb", "sb")).alias("p"))
            each = rows.join(F.broadcast(planes), "bin").select("bin", "y", "a", "b", F.inline("p"))
            off = F.col("y") - F.col("c0") - F.col("ca") * (F.col("a") - F.col("ma")) / F.col("sa") - F.col("cb") * (F.col("b") - F.col("mb")) / F.col("sb")
            each = each.withColumn("side", F.when(off > F.col("near"), 1).when(off < -F.col("near"), -1).otherwise(0)).select("bin", "q", "y", "a", "b", "side")
            sums = each.where("side <> 0").groupBy("bin", "q", "side").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("y", "a", "b")]).collect()
            far = {}
            for r in sums:
                s = shape[r["bin"]]
                far.setdefault((r["bin"], r["q"]), []).append((r["y"], r["n"], (r["a"] - r["n"] * s["ma"]) / s["sa"], (r["b"] - r["n"] * s["mb"]) / s["sb"]))

            def settle(t: pa.Table, far: dict = far) -> pa.Table:
                k, q, (v, va, vb) = t["bin"][0].as_py(), t["q"][0].as_py(), columns(t)
                others = np.array(far.get((k, q), [])).reshape(-1, 4)
                p = best_plane(np.concatenate([standard(k, va, vb), others[:, 1:]]), np.concatenate([v, others[:, 0]]), q, passes)
                return pa.Table.from_pylist([{"bin": k, "q": q, "c0": p[0], "ca": p[1], "cb": p[2], "near": 0.0, "distinct": 3}], schema)

            got = {(r["bin"], r["q"]): np.array([r["c0"], r["ca"], r["cb"]]) for r in each.where("side = 0").drop("side").groupBy("bin", "q").applyInArrow(lambda t: settle(t), _FIT).collect()}
            again = {}
            for (k, q), d in near.items():
                s, new = shape[k], got.get((k, q), found[k, q])
                corners = standard(k, np.array([s["low_a"], s["low_a"], s["high_a"], s["high_a"]]), np.array([s["low_b"], s["high_b"], s["low_b"], s["high_b"]]))
                if (k, q) not in got or np.abs(corners @ (new - found[k, q])).max() > d:
                    again[k, q] = 2 * d
                found[k, q] = new
            near = again
    finally:
        rows.unpersist()
    table = []
    for k in range(bins):
        for q in quantiles:
            if (k, q) in found:
                (c0, ca, cb), r = map(float, found[k, q]), shape[k]
                table.append(((k + 1) * step, q, c0 - ca * r["ma"] / r["sa"] - cb * r["mb"] / r["sb"], ca / r["sa"], cb / r["sb"]))
            else:
                table.append(((k + 1) * step, q, None, None, None))
    return spark.createDataFrame(table, "lead_h double, q double, b0 double, b_speed double, b_lat double")
