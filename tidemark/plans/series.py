"""SQL of the queries on resampled series: autocorrelation, spectra, coherence, resampling and least squares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import resample
from tidemark.plans import views
from tidemark.plans.registry import _GAPS, ORACLE_SQL, _with, drawn, fq, r
from tidemark.plans.reports import _PERSISTENCE

STEP_US, N, RATE = 4 * 3_600_000_000, 42, 6.0


def resampled(rows: str, keys: str) -> str:
    """(keys, i, us, u, v) every four hours of rows (keys, us, u, v), linear between, the last value held."""
    one = f"SELECT {keys}, us, min({{'u': u, 'v': v}}) AS x FROM ({rows}) WHERE u IS NOT NULL AND v IS NOT NULL GROUP BY ALL"
    known = f"SELECT *, lead(us) OVER w AS us1, lead(x) OVER w AS x1 FROM ({one}) WINDOW w AS (PARTITION BY {keys} ORDER BY us)"
    targets = f"SELECT {keys}, i, o + i * {STEP_US} AS us FROM (SELECT {keys}, o, unnest(range((l - o + 2 * {STEP_US} - 1) // {STEP_US})) AS i FROM (SELECT {keys}, min(us) AS o, max(us) AS l FROM ({one}) GROUP BY ALL))"
    on = " AND ".join(f"t.{k.strip()} = k.{k.strip()}" for k in keys.split(","))
    share = "(t.us - k.us) / (us1 - k.us)::DOUBLE"
    mixed = ", ".join(f"CASE WHEN us1 IS NULL THEN k.x.{c} ELSE k.x.{c} + (k.x1.{c} - k.x.{c}) * {share} END AS {c}" for c in "uv")
    return f"SELECT {', '.join(f't.{k.strip()}' for k in keys.split(','))}, i, t.us, {mixed} FROM ({targets}) t ASOF JOIN ({known}) k ON {on} AND t.us >= k.us"


_KEYS = "buoy_id, segment, chunk_no"
_EVEN = resampled(f"SELECT *, epoch_us(ts) AS us FROM ({_GAPS})", "buoy_id, segment")
#: Whole weeks of series that last one, less a step: a row for each value with its number j and the chunk's means.
CHUNKS = f"""SELECT {_KEYS}, start_us, j, u, v, sqrt(u * u + v * v) AS s, u - avg(u) OVER c AS du, v - avg(v) OVER c AS dv FROM (
  SELECT *, i - chunk_no * {N} AS j, min(us) OVER c AS start_us, count(*) OVER c AS n_chunk FROM (
  SELECT *, i // {N} AS chunk_no, max(us) OVER (PARTITION BY buoy_id, segment) - min(us) OVER (PARTITION BY buoy_id, segment) AS span FROM ({_EVEN}))
  WHERE span / 8.64e10 >= 7 - 4 / 24.0::DOUBLE WINDOW c AS (PARTITION BY {_KEYS})) WHERE n_chunk = {N} WINDOW c AS (PARTITION BY {_KEYS})"""

_PAIRS = f"(SELECT a.buoy_id, a.segment, a.chunk_no, (b.j - a.j)::INT AS lag, a.u AS u0, b.u AS u1, a.v AS v0, b.v AS v1, a.s AS s0, b.s AS s1, a.du * b.du + a.dv * b.dv AS p FROM chunked a JOIN chunked b USING ({_KEYS}) WHERE b.j >= a.j)"


def on_chunks(sql: str) -> str:
    return _with(f"SELECT * FROM (WITH chunked AS MATERIALIZED ({CHUNKS}) {sql})")


ORACLE_SQL["i1_i5_acf_job"] = on_chunks(f"""SELECT buoy_id, segment::BIGINT AS segment, chunk_no, lag, {r('p / p0 AS r')} FROM (SELECT {_KEYS}, lag, sum(p) AS p FROM {_PAIRS} GROUP BY ALL)
  JOIN (SELECT {_KEYS}, sum(du * du + dv * dv) AS p0 FROM chunked GROUP BY ALL) USING ({_KEYS}) WHERE lag <= {N - 2}""")
ORACLE_SQL["i4_scalar_acf"] = on_chunks(f"SELECT buoy_id, segment::BIGINT AS segment, chunk_no, lag, {r('corr(u0, u1) AS r_u', 'corr(v0, v1) AS r_v', 'corr(s0, s1) AS r_speed')} FROM {_PAIRS} WHERE lag <= {N - 2} GROUP BY ALL")


def fourier(value: str, frequencies: str, name: str) -> str:
    """The real and imaginary sums of a real value by chunk and frequency."""
    turn = f"2 * pi() * ((j * k) % {N}) / {N}"
    return f"sum({value} * cos({turn})) AS {name}_re, -sum({value} * sin({turn})) AS {name}_im"


def _sums(values: dict[str, str], first: int, last: int) -> str:
    parts = ", ".join(fourier(v, "k", name) for name, v in values.items())
    return f"(SELECT {_KEYS}, start_us, k, {parts} FROM chunked, (SELECT unnest(range({first}, {last + 1}))::INT AS k) GROUP BY ALL)"


ORACLE_SQL["i9_i11_mean_spectrum"] = on_chunks(f"""SELECT k, {r(f'k * {RATE} / {N} AS per_day', f'avg(2 / ({RATE} * {N}) * (pow(a_re - b_im, 2) + pow(a_im + b_re, 2))) AS power')}
  FROM {_sums({'a': 'du', 'b': 'dv'}, 1, (N + 1) // 2 - 1)} GROUP BY k""")
_HANN = f"(0.5 - 0.5 * cos(2 * pi() * j / {N}))"
ORACLE_SQL["i10_welch"] = on_chunks(f"""SELECT k, {r(f'k * {RATE} / {N} AS per_day', f'avg((a_re * a_re + a_im * a_im) * CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END / ({RATE} * (SELECT sum(pow({_HANN}, 2)) FROM (SELECT unnest(range({N})) AS j)))) AS power')}
  FROM {_sums({'a': f'du * {_HANN}'}, 0, N // 2)} GROUP BY k""")
#: Means over chunks of the auto and cross spectra of u and v.
_CROSS = f"SELECT *, a_re * a_re + a_im * a_im AS aa, b_re * b_re + b_im * b_im AS bb, a_re * b_re + a_im * b_im AS cr, a_im * b_re - a_re * b_im AS ci FROM {_sums({'a': 'du', 'b': 'dv'}, 0, N // 2)}"
ORACLE_SQL["i12_i13_coherence"] = on_chunks(f"SELECT k, {r('CASE WHEN k > 0 THEN (pow(avg(cr), 2) + pow(avg(ci), 2)) / (avg(aa) * avg(bb)) END AS coherence')} FROM ({_CROSS}) GROUP BY k")
ORACLE_SQL["e3_regular_resample"] = _with(f"SELECT buoy_id, i, {r('u', 'v')} FROM ({resampled('SELECT *, epoch_us(ts) AS us FROM legs', 'buoy_id')})")


def two_predictors(rows: str, keys: str = "") -> str:
    """(keys, n, p_re, p_im, q_re, q_im, ...): least squares on anomalies of y by two complex predictors p and q, by Cramer's rule."""
    over = f"OVER (PARTITION BY {keys})" if keys else "OVER ()"
    by = f"{keys}, " if keys else ""
    centred = ", ".join(f"{c}{x} - avg({c}{x}) {over} AS {c}{x}" for c in "ypq" for x in "ri")
    products = ", ".join(f"avg({a}r * {b}r + {a}i * {b}i) AS {a}{b}r, avg({a}r * {b}i - {a}i * {b}r) AS {a}{b}i" for a in "pqy" for b in "pqy")
    # det = pp qq - |pq|^2; p = (py qq - pq qy) / det, q = (qy pp - qp py) / det
    det = "(ppr * qqr - pqr * pqr - pqi * pqi)"
    return f"""SELECT {by}n, ppr, yyr, ypr, ypi, pyr, pyi,
      (pyr * qqr - (pqr * qyr - pqi * qyi)) / {det} AS p_re, (pyi * qqr - (pqr * qyi + pqi * qyr)) / {det} AS p_im,
      (qyr * ppr - (qpr * pyr - qpi * pyi)) / {det} AS q_re, (qyi * ppr - (qpr * pyi + qpi * pyr)) / {det} AS q_im
      FROM (SELECT {by}count(*) AS n, {products} FROM (SELECT {by}{centred} FROM ({rows})) {'GROUP BY ' + keys if keys else ''})"""


_MADE = "SELECT u AS yr, v AS yi, u * 2 + (fix_id % 13) / 8.0::DOUBLE AS wr, v - (fix_id % 7) / 4.0::DOUBLE AS wi, (fix_id % 11) / 3.0::DOUBLE AS sr, (fix_id % 17) / 5.0::DOUBLE AS si FROM cleaned"
ORACLE_SQL["h3_h4_h8_least_squares"] = _with(f"SELECT n, {r('p_re AS c_w_re', 'p_im AS c_w_im', 'q_re AS c_s_re', 'q_im AS c_s_im')} FROM ({two_predictors(f'SELECT yr, yi, wr AS pr, wi AS pi, sr AS qr, si AS qi FROM ({_MADE})')})")
_MODELS = f"SELECT 'current' AS model, yr, yi, wr AS pr, wi AS pi, wi AS qr, sr AS qi FROM ({_MADE}) UNION ALL SELECT 'wave', yr, yi, sr, si, wi, sr FROM ({_MADE})"
ORACLE_SQL["h9_model_sweep"] = _with(f"""SELECT model, n, {r('sqrt(ypr * ypr + ypi * ypi) / sqrt(yyr * ppr) AS r_x', 'degrees(atan2(ypi, ypr)) AS angle_x', 'p_re AS c_x_re', 'p_im AS c_x_im', 'q_re AS c_turn_re', 'q_im AS c_turn_im')}
  FROM ({two_predictors(_MODELS, 'model')})""")

# -- bands by resampled blocks of time
_BLOCKS = f"SELECT {_KEYS}, dense_rank() OVER (ORDER BY (start_us - (SELECT min(start_us) FROM chunked)) // 432000000000) - 1 AS block FROM (SELECT DISTINCT {_KEYS}, start_us FROM chunked)"
_TIMES = f"SELECT resample, idx AS block, count(*) AS c FROM (SELECT resample, {drawn('resample', 'draw', 'n')} AS idx FROM (SELECT unnest(range(1000)) AS resample), (SELECT n, unnest(range(n)) AS draw FROM (SELECT max(block) + 1 AS n FROM blocks))) GROUP BY ALL"
_BAND = ("avg(m) AS mean", "quantile_cont(m, 0.025) AS low", "quantile_cont(m, 0.975) AS high")


def in_blocks(sql: str) -> str:
    return on_chunks(f", blocks AS MATERIALIZED ({_BLOCKS}), times AS MATERIALIZED ({_TIMES}) {sql}")


_ACF = f"SELECT {_KEYS}, lag, p / p0 AS r FROM (SELECT {_KEYS}, lag, sum(p) AS p FROM {_PAIRS} GROUP BY ALL) JOIN (SELECT {_KEYS}, sum(du * du + dv * dv) AS p0 FROM chunked GROUP BY ALL) USING ({_KEYS}) WHERE lag <= {N - 2}"
_CURVE = f"""SELECT lag, {', '.join(_BAND)} FROM (SELECT resample, lag, sum(c * s) / sum(c * n) AS m FROM (SELECT block, lag, sum(r) AS s, count(r) AS n FROM ({_ACF}) JOIN blocks USING ({_KEYS}) GROUP BY ALL) JOIN times USING (block) GROUP BY ALL) GROUP BY lag"""
ORACLE_SQL["i7_i8_block_bootstrap"] = in_blocks(f"SELECT lag, {r('mean AS mean', 'low AS low', 'high AS high')} FROM ({_CURVE})")
_QUARTERS = [f"a.{c} + coalesce((b.{c} - a.{c}) * (i % 16) / 16.0::DOUBLE, 0) AS {c}" for c in ("mean", "low", "high")]
ORACLE_SQL["r3_e7_acf_curve"] = in_blocks(f"""SELECT i, i * 900000000 AS us, {r(*_QUARTERS)} FROM (SELECT unnest(range({(N - 2) * 16 + 1})) AS i) JOIN ({_CURVE}) a ON a.lag = i // 16 LEFT JOIN ({_CURVE}) b ON b.lag = i // 16 + 1""")
_COHERENT = f"""SELECT k, {', '.join(_BAND)} FROM (SELECT resample, k, CASE WHEN k > 0 THEN (pow(sum(c * cr), 2) + pow(sum(c * ci), 2)) / (sum(c * aa) * sum(c * bb)) END AS m
  FROM (SELECT block, k, sum(aa) AS aa, sum(bb) AS bb, sum(cr) AS cr, sum(ci) AS ci FROM ({_CROSS}) JOIN blocks USING ({_KEYS}) GROUP BY ALL) JOIN times USING (block) GROUP BY resample, k) GROUP BY k"""
ORACLE_SQL["i14_coherence_band"] = in_blocks(f"SELECT k, {r('mean AS mean', 'low AS low', 'high AS high')} FROM ({_COHERENT})")
ORACLE_SQL["r4_coherence"] = in_blocks(f"""SELECT k, {r('coherence', 'b.mean AS drawn', 'b.low AS low', 'b.high AS high')} FROM
  (SELECT k, CASE WHEN k > 0 THEN (pow(avg(cr), 2) + pow(avg(ci), 2)) / (avg(aa) * avg(bb)) END AS coherence FROM ({_CROSS}) GROUP BY k) JOIN ({_COHERENT}) b USING (k)""")

_RMSE = "sqrt(avg(error_km * error_km))"
ORACLE_SQL["r6_g22_model_table"] = _with(f"""SELECT model, {r('sqrt(ypr * ypr + ypi * ypi) / sqrt(yyr * ppr) AS r', 'sqrt(pyr * pyr + pyi * pyi) / ppr AS z', 'degrees(atan2(ypi, ypr)) AS phase', 'sqrt(q_re * q_re + q_im * q_im) AS second')},
  (SELECT {r(f'{_RMSE} AS rmse')} FROM errors WHERE lead_h > 166 AND lead_h < 170) AS rmse_raw,
  (SELECT {r(f'{_RMSE} AS rmse')} FROM ({_PERSISTENCE}) t(model, lead_h, error_km) WHERE lead_h > 166 AND lead_h < 170) AS rmse_corrected FROM ({two_predictors(_MODELS, 'model')})""")

# -- positions and forecasts on even axes
_POSITIONS = resampled("SELECT buoy_id, epoch_us(ts) AS us, lon AS u, lat AS v FROM fixes", "buoy_id")
fq("e4_regular_positions", f"SELECT buoy_id, i, {r('u AS lon', 'v AS lat')} FROM ({_POSITIONS})")(
    lambda f: resample.regular(f.withColumn("us", F.unix_micros("ts")), ["buoy_id"], "us", ["lon", "lat"], STEP_US).select("buoy_id", "i", "lon", "lat")
)


def _lead_grid(f: DataFrame) -> DataFrame:
    """The truth of each run on leads of whole four hours, from its first lead to its last (E5)."""
    run = views.runs(f).select("buoy_id", F.col("day").cast("string").alias("start_day"), F.round(F.col("lead_h") * 3.6e9).cast("long").alias("x"), "lat_true", "lon_true", F.lit(0).cast("long").alias("zero"))
    return resample.regular(run, ["buoy_id", "start_day"], "x", ["lat_true", "lon_true"], STEP_US, origin="zero", clamp=False)


_LEADS = "SELECT buoy_id, day::VARCHAR AS start_day, round(lead_h * 3.6e9)::BIGINT AS x, min({'lat': lat_true, 'lon': lon_true}) AS p FROM runs GROUP BY ALL"
_GRID = f"SELECT buoy_id, start_day, i, i * {STEP_US} AS x FROM (SELECT buoy_id, start_day, unnest(range((a + {STEP_US} - 1) // {STEP_US}, b // {STEP_US} + 1)) AS i FROM (SELECT buoy_id, start_day, min(x) AS a, max(x) AS b FROM ({_LEADS}) GROUP BY ALL))"
_AT = "(t.x - k.x) / (x1 - k.x)::DOUBLE"
fq("e5_lead_grid", f"""SELECT t.buoy_id, t.start_day, t.x, i, {r(*[f"CASE WHEN p1 IS NULL THEN k.p.{c} ELSE k.p.{c} + (p1.{c} - k.p.{c}) * {_AT} END AS {c}_true" for c in ('lat', 'lon')])} FROM ({_GRID}) t
  ASOF JOIN (SELECT *, lead(x) OVER w AS x1, lead(p) OVER w AS p1 FROM ({_LEADS}) WINDOW w AS (PARTITION BY buoy_id, start_day ORDER BY x)) k ON t.buoy_id = k.buoy_id AND t.start_day = k.start_day AND t.x >= k.x""")(_lead_grid)
