"""Registered queries of bias coefficients, the sweep over all predictors, applied fits and skill by model, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cregress, tracks, verify
from tidemark.plans.registry import fq, r
from tidemark.plans.reports import _PERSISTENCE, by_model
from tidemark.plans.series import two_predictors

# Depths in metres at which currents are mapped.
DEPTHS = [0.494, 5.0782, 29.4447, 55.7643, 109.7293]
#: (config, depth, use_current, use_wind, use_stokes)
CONFIGS = [(1, 3.0, True, True, True), (2, 40.0, True, False, True), (3, 200.0, True, False, False), (4, 30.0, False, True, True), (5, 0.0, False, False, False)]
MODELS = ["surface", "at_1m", "at_5m", "default", "at_30m", "at_55m", "at_110m", "stokes_drift", "with_drift"]


def _made(f: DataFrame) -> DataFrame:
    """Cleaned legs with nine currents (x0 .. x8), a wind and a drift; each tenth current at 5 m is missing."""
    out = {}
    for k in range(len(MODELS)):
        out |= {f"x{k}_u": F.col("u") * (1 + k / 8) + (F.col("fix_id") % (11 + 2 * k)) / 8.0, f"x{k}_v": F.col("v") - (F.col("fix_id") % (7 + k)) / 4.0}
    out["x1_u"] = F.when(F.col("fix_id") % 10 > 0, out["x1_u"])
    return tracks.clean(f).withColumns(out | {"w_u": (F.col("fix_id") % 13) / 3.0, "w_v": (F.col("fix_id") % 17) / 5.0, "s_u": (F.col("fix_id") % 19) / 7.0, "s_v": (F.col("fix_id") % 5) / 9.0})


def _x(k: int) -> tuple[str, str]:
    u = f"(u * {1 + k / 8}::DOUBLE + (fix_id % {11 + 2 * k}) / 8.0::DOUBLE)"
    return (f"CASE WHEN fix_id % 10 > 0 THEN {u} END" if k == 1 else u), f"(v - (fix_id % {7 + k}) / 4.0::DOUBLE)"


_WIND, _DRIFT = ("((fix_id % 13) / 3.0::DOUBLE)", "((fix_id % 17) / 5.0::DOUBLE)"), ("((fix_id % 19) / 7.0::DOUBLE)", "((fix_id % 5) / 9.0::DOUBLE)")


def _less(c: str, by: str) -> str:
    """Two columns: c without its part along ``by``, both centred complex numbers."""
    size = f"nullif(avg({by}r * {by}r + {by}i * {by}i) OVER (), 0)"
    re, im = f"avg({by}r * {c}r + {by}i * {c}i) OVER () / {size}", f"avg({by}r * {c}i - {by}i * {c}r) OVER () / {size}"
    return f"{c}r - ({re} * {by}r - {im} * {by}i) AS {c}r, {c}i - ({re} * {by}i + {im} * {by}r) AS {c}i"


def _coefficient(rows: str, of: str, others: list[str]) -> str:
    """Real and imaginary part of the coefficient of one predictor: what is left of it and of the target once the others are taken out."""
    left = list(others)
    while left:
        by, left = left[0], left[1:]
        rows = f"SELECT {', '.join(_less(c, by) for c in ('y', of, *left))} FROM ({rows})"
    size = f"sum({of}r * {of}r + {of}i * {of}i)"
    return f"(SELECT [sum({of}r * yr + {of}i * yi) / {size}, sum({of}r * yi - {of}i * yr) / {size}] FROM ({rows}))"


def _config_sql(config: int, depth: float, *used: bool) -> str:
    k = min(range(len(DEPTHS)), key=lambda i: abs(DEPTHS[i] - depth))
    on = [p for p, flag in zip("xws", used, strict=True) if flag]
    columns = {"y": ("u", "v"), "x": _x(k), "w": _WIND, "s": _DRIFT}
    rows = f"SELECT * FROM (SELECT {', '.join(f'{c[0]} AS {n}r, {c[1]} AS {n}i' for n, c in columns.items())} FROM cleaned) WHERE xr IS NOT NULL AND yr IS NOT NULL"
    centred = f"SELECT {', '.join(f'{n}{p} - avg({n}{p}) OVER () AS {n}{p}' for n in columns for p in 'ri')} FROM ({rows})"
    names = {"x": "current", "w": "wind", "s": "stokes"}
    told = [f"{config}::BIGINT AS config, {DEPTHS[k]}::DOUBLE AS matched_depth, (SELECT count(*) FROM ({rows})) AS n"]
    for p, name in names.items():
        both = _coefficient(centred, p, [q for q in on if q != p]) if p in on else "([0.0, 0.0]::DOUBLE[])"
        told += [r(f"{both}[1] AS c_{name}_re", f"{both}[2] AS c_{name}_im")]
        told += [r(*[f"(SELECT avg({p}{c}) FROM ({rows})) AS m_{name}_{part}" if p in on else f"0.0::DOUBLE AS m_{name}_{part}" for c, part in (("r", "re"), ("i", "im"))])]
    told += [r(*[f"(SELECT avg(y{c}) FROM ({rows})) AS m_y_{part}" if "x" in on else f"0.0::DOUBLE AS m_y_{part}" for c, part in (("r", "re"), ("i", "im"))])]
    return f"SELECT {', '.join(told)}"


def _bias(f: DataFrame) -> DataFrame:
    configs = f.sparkSession.createDataFrame(CONFIGS, "config long, depth double, use_current boolean, use_wind boolean, use_stokes boolean")
    currents = {d: (f"x{k}_u", f"x{k}_v") for k, d in enumerate(DEPTHS)}
    return cregress.bias_coefficients(_made(f), ("u", "v"), currents, ("w_u", "w_v"), ("s_u", "s_v"), configs)


fq("h8_bias_coefficients", " UNION ALL ".join(_config_sql(*c) for c in CONFIGS))(_bias)

#: Predictor and second predictor of each row of the sweep: nine currents with the wind, the wind with the drift, and one current with the drift.
_SWEEP = {m: (_x(k), _WIND) for k, m in enumerate(MODELS)} | {"wind": (_WIND, _DRIFT), "at_30m_and_stokes": (_x(4), _DRIFT)}
_SWEEP_ROWS = " UNION ALL ".join(f"SELECT '{m}' AS model, u AS yr, v AS yi, {p[0]} AS pr, {p[1]} AS pi, {q[0]} AS qr, {q[1]} AS qi FROM cleaned" for m, (p, q) in _SWEEP.items())
_SWEEP_KNOWN = f"SELECT * FROM ({_SWEEP_ROWS}) WHERE pr IS NOT NULL AND yr IS NOT NULL"


def _swept(f: DataFrame) -> DataFrame:
    models = {m: (f"x{k}_u", f"x{k}_v", "w_u", "w_v") for k, m in enumerate(MODELS)} | {"wind": ("w_u", "w_v", "s_u", "s_v"), "at_30m_and_stokes": ("x4_u", "x4_v", "s_u", "s_v")}
    return cregress.full_sweep(_made(f), ("u", "v"), models)


_FITTED = f"""SELECT model, yr - avg(yr) OVER m AS yr, yi - avg(yi) OVER m AS yi, p_re * (pr - avg(pr) OVER m) - p_im * (pi - avg(pi) OVER m) + q_re * (qr - avg(qr) OVER m) - q_im * (qi - avg(qi) OVER m) AS fr,
  p_re * (pi - avg(pi) OVER m) + p_im * (pr - avg(pr) OVER m) + q_re * (qi - avg(qi) OVER m) + q_im * (qr - avg(qr) OVER m) AS fi FROM known JOIN coefs USING (model) WINDOW m AS (PARTITION BY model)"""
fq("h9_nine_models", f"""SELECT * FROM (WITH known AS ({_SWEEP_KNOWN}), coefs AS ({two_predictors('SELECT * FROM known', 'model')}),
  reg AS (SELECT model, sum(yr * fr + yi * fi) AS re, sum(yr * fi - yi * fr) AS im, sum(yr * yr + yi * yi) AS yy, sum(fr * fr + fi * fi) AS ff FROM ({_FITTED}) GROUP BY model),
  sizes AS (SELECT model, avg(sqrt(pr * pr + pi * pi)) AS sp, avg(sqrt(qr * qr + qi * qi)) AS sq FROM known GROUP BY model)
  SELECT model, n, {r('sqrt(ypr * ypr + ypi * ypi) / sqrt(yyr * ppr) AS r_raw', 'degrees(atan2(ypi, ypr)) AS angle_raw', 'pyr / ppr AS z_re', 'pyi / ppr AS z_im', 'sqrt(ypr * ypr + ypi * ypi) / sqrt(yyr * ppr) AS r_z', '0.0::DOUBLE AS angle_z',
  'p_re AS c_x_re', 'p_im AS c_x_im', 'q_re AS c_w_re', 'q_im AS c_w_im', 'sqrt(re * re + im * im) / sqrt(yy * ff) AS r_reg', 'degrees(atan2(im, re)) AS angle_reg',
  'sqrt(p_re * p_re + p_im * p_im) * sp / (sqrt(p_re * p_re + p_im * p_im) * sp + sqrt(q_re * q_re + q_im * q_im) * sq) AS share_x', 'sqrt(q_re * q_re + q_im * q_im) * sq / (sqrt(p_re * p_re + p_im * p_im) * sp + sqrt(q_re * q_re + q_im * q_im) * sq) AS share_w')}
  FROM coefs JOIN reg USING (model) JOIN sizes USING (model))""")(_swept)


def _applied(f: DataFrame) -> DataFrame:
    """The fit by one current and the wind, and Z on that current, at every fix (H5, H6)."""
    rows = _made(f).select("fix_id", "u", "v", "x0_u", "x0_v", "w_u", "w_v")
    g = cregress.gram(rows, ("u", "v"), {"x": ("x0_u", "x0_v"), "w": ("w_u", "w_v")})
    fit = cregress.least_squares(cregress.scale(g, "x"), ["x", "w"])
    both = cregress.apply(rows, fit, {"x": ("x0_u", "x0_v"), "w": ("w_u", "w_v")}).withColumnsRenamed({"fit_u": "reg_u", "fit_v": "reg_v"})
    return cregress.apply_scale(both, fit, "x", ("x0_u", "x0_v")).select("fix_id", "reg_u", "reg_v", F.col("fit_u").alias("z_u"), F.col("fit_v").alias("z_v"))


_ROWS0 = f"SELECT fix_id, u AS yr, v AS yi, {_x(0)[0]} AS pr, {_x(0)[1]} AS pi, {_WIND[0]} AS qr, {_WIND[1]} AS qi FROM cleaned"
_DP, _DQ = ("(pr - avg(pr) OVER ())", "(pi - avg(pi) OVER ())"), ("(qr - avg(qr) OVER ())", "(qi - avg(qi) OVER ())")
fq("h5_h6_applied", f"""SELECT fix_id, {r(f'p_re * {_DP[0]} - p_im * {_DP[1]} + q_re * {_DQ[0]} - q_im * {_DQ[1]} + avg(yr) OVER () AS reg_u', f'p_re * {_DP[1]} + p_im * {_DP[0]} + q_re * {_DQ[1]} + q_im * {_DQ[0]} + avg(yi) OVER () AS reg_v',
  f'(pyr * {_DP[0]} - pyi * {_DP[1]}) / ppr + avg(pr) OVER () AS z_u', f'(pyr * {_DP[1]} + pyi * {_DP[0]}) / ppr + avg(pi) OVER () AS z_v')} FROM ({_ROWS0}), ({two_predictors(_ROWS0)})""")(_applied)

_SKILLED = f"""SELECT model, bin, avg(skill) AS skill FROM (SELECT model, (ceil(lead_h / 4) - 1)::INT AS bin, CASE WHEN path > 0 THEN greatest(0.0, 1 - error_km / path) END AS skill FROM (
  SELECT *, sum(st) OVER (PARTITION BY model, buoy_id, start_ts ORDER BY lead_h) AS path FROM (
  SELECT *, 110 * sqrt(pow(lat_true - lag(lat_true) OVER w, 2) + pow(lon_true - lag(lon_true) OVER w, 2)) AS st FROM (
  SELECT 'no_motion' AS model, buoy_id, start_ts, lead_h, lat_true, lon_true, error_km FROM errors UNION ALL SELECT 'persistence', s.buoy_id, s.start_ts, lead_h, lat_true, lon_true, {_PERSISTENCE.split("lead_h, ", 1)[1]})
  WINDOW w AS (PARTITION BY model, buoy_id, start_ts ORDER BY lead_h))) WHERE lead_h > 0 AND lead_h <= 192) GROUP BY model, bin"""
fq("g21_skill_by_model", f"SELECT model, {r('bin * 4.0 + 4 AS lead_hi', 'skill AS skill')} FROM ({_SKILLED}) UNION ALL SELECT unnest(['no_motion', 'persistence']), 0.0, 0.0")(
    lambda f: verify.mean_skill(verify.skill_path(by_model(f), keys=["model"]), keys=["model"])
)
