"""Registered queries that put several operators together: enriched forecasts, surfaces, fields and reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import bins
from tidemark.operators import bootstrap, cregress, field, forecast, quantiles, quantreg, resample, selection, spectra, tracks, verify
from tidemark.plans import views
from tidemark.plans.registry import D8, by_time, drawn, fq, hav, r
from tidemark.sources.scratch import written

#: Edges of the 2-D error bins: first speed difference and first latitude.
SPEED_EDGES = [0.0, 1 / 7, 2 / 7, 3 / 7, 4 / 7, 1.0]
LAT_EDGES = [4.5, 5.0, 5.5, 6.0, 6.5, 7.0, 7.5]
QUANTILES = (0.3, 0.5, 0.7, 0.9)
OBS_TOLERANCE_S = 60


# -- tables


def modelled(fx: DataFrame) -> DataFrame:
    """Runs with errors, the velocity observed on each fix's leg (u, v) and a model's (mu, mv)."""
    seen = tracks.legs(fx).select("buoy_id", "fix_id", "u", "v")
    mu, mv = F.sin(F.col("fix_id") % 50), F.cos(F.col("fix_id") % 50) / 2
    return verify.position_error(views.runs(fx)).join(seen, ["buoy_id", "fix_id"]).withColumns({"mu": mu, "mv": mv})


def errors(fx: DataFrame) -> DataFrame:
    """Runs with errors, the first latitude and a first speed difference between 0 and 1."""
    e = verify.initial_position(verify.position_error(views.runs(fx))).withColumn("_d", (F.col("fix_id") % 97) / 97.0)
    return e.withColumn("diff_init", verify.first_known("_d")).drop("_d")


def surface(fx: DataFrame) -> DataFrame:
    """(lead_h, q, b0, b_speed, b_lat): a plane for each lead bin and quantile from the bin's own quantiles and mean.

    It stands in for the fitted surface where SQL must give the same numbers; at most bins times quantiles rows. The errors are
    written once, and no task holds those of a bin.
    """
    rows = verify.position_error(views.runs(fx)).withColumn("bin", verify.lead_bin(F.col("lead_h"))).where("bin is not null")
    rows = written(rows.select("bin", "error_km"), "binned")
    wide = quantiles.select(rows, ["bin"], "error_km", QUANTILES).select("bin", F.col("quantiles").alias("p"))
    wide = wide.join(rows.groupBy("bin").agg(F.avg("error_km").alias("m")), "bin")
    long = wide.select("bin", "m", F.posexplode("p").alias("i", "b0"))
    q = F.element_at(F.array(*map(F.lit, QUANTILES)), F.col("i") + 1)
    return long.select(((F.col("bin") + 1) * verify.LEAD_STEP).alias("lead_h"), q.alias("q"), "b0", (F.col("m") / 10).alias("b_speed"), (-F.col("m") / 100).alias("b_lat"))


def fitted(fx: DataFrame) -> DataFrame:
    """The surface fitted by quantile regression, all 41 lead bins and nine quantiles."""
    return quantreg.surface(errors(fx))


def monthly(fx: DataFrame) -> DataFrame:
    """(month, lat, lon, u, v): twelve means on half degrees, of the fixes by their number."""
    u, v = (F.col("fix_id") % 101 - 50) / 63.0, (F.col("fix_id") % 89 - 44) / 61.0
    cell = [(F.col("fix_id") % 12 + 1).cast("int").alias("month"), (F.floor(F.col("lat") * 2) / 2).alias("lat"), (F.floor(F.col("lon") * 2) / 2).alias("lon")]
    return fx.groupBy(*cell).agg(F.avg(u).alias("u"), F.avg(v).alias("v"))


def three_products(fx: DataFrame) -> DataFrame:
    """A current, a wind and a wave drift (u, v, uw, vw, ust, vst) on each cell of the sampled field."""
    return views.sampled_field(fx).withColumns({"uw": F.col("v") * 2, "vw": F.col("u") - 1, "ust": F.col("u") / 4, "vst": F.col("v") / 8})


def second_track(fx: DataFrame) -> DataFrame:
    """A forecast track (run_id, ts, lon, lat): each buoy's every third fix, moved a little."""
    return fx.where("fix_id % 3 = 0").select(F.col("buoy_id").alias("run_id"), "ts", (F.col("lon") + 0.25).alias("lon"), (F.col("lat") - 0.5).alias("lat"))


def _at(name: str = "time") -> Column:
    return F.unix_seconds(F.col(name).cast("timestamp"))


START_MINUTE = "round_even((epoch_us(ts) - round(lead_h * 3.6e9)::BIGINT) / 60000000, 0)::BIGINT"
MODELLED = "(SELECT e.*, l.u, l.v, sin(e.fix_id % 50) AS mu, cos(e.fix_id % 50) / 2 AS mv FROM errors e JOIN legs l ON e.buoy_id = l.buoy_id AND e.fix_id = l.fix_id)"
RANKED = "(SELECT *, arg_min(lat_true, lead_h) OVER w AS lat_init, arg_min((fix_id % 97) / 97.0::DOUBLE, lead_h) OVER w AS diff_init FROM errors WINDOW w AS (PARTITION BY buoy_id, start_ts))"
SURFACE = "(" + " UNION ALL ".join(f"SELECT (bin + 1) * 4.0::DOUBLE AS lead_h, {q}::DOUBLE AS q, quantile_cont(error_km, {q}) AS b0, avg(error_km) / 10 AS b_speed, -avg(error_km) / 100 AS b_lat FROM binned GROUP BY bin" for q in QUANTILES) + ")"
DIFF, SEEN, SAID = "sqrt(pow(mu - u, 2) + pow(mv - v, 2))", "sqrt(u * u + v * v)", "sqrt(mu * mu + mv * mv)"
ALONG = f"(u * mu + v * mv) / nullif({SEEN}, 0)"
ANGLE = f"CASE WHEN {ALONG} IS NOT NULL AND {SAID} > 0 THEN degrees(acos(greatest(-1.0, least(1.0, {ALONG} / {SAID})))) END"


# -- forecasts and their first values


def _start_minutes(f: DataFrame) -> DataFrame:
    at = forecast.leads(f).withColumn("_s", verify.start_time(F.col("ts"), F.col("lead_h")))
    return at.select("buoy_id", "fix_id", _at("start_ts").alias("run"), F.expr("unix_micros(_s) div 60000000").alias("minute"))


fq("g1_start_time", f"SELECT buoy_id, fix_id, epoch_us(start_ts) // 1000000 AS run, {START_MINUTE} AS minute FROM runs")(_start_minutes)
fq("g3_initial_position", f"SELECT buoy_id, day::VARCHAR AS start_day, {r('arg_min(lat_true, lead_h) AS lat_init', 'arg_min(lon_true, lead_h) AS lon_init')} FROM runs WHERE fix_id % 3 <> 0 GROUP BY buoy_id, day")(
    lambda f: verify.initial_position(forecast.leads(f).withColumns({c: F.when(F.col("fix_id") % 3 != 0, F.col(c)) for c in ("lat_true", "lon_true")}))
    .where("lat_init is not null").select("buoy_id", F.col("day").cast("string").alias("start_day"), "lat_init", "lon_init").distinct()
)
fq("g4_g5_initial_mismatch", f"""SELECT buoy_id, day::VARCHAR AS start_day, {r(f'arg_min({DIFF}, lead_h) AS diff_init', f'arg_min({ALONG}, lead_h) AS along_init')}, round(arg_min({ANGLE}, lead_h), 3) AS angle_init
  FROM {MODELLED} GROUP BY buoy_id, day""")(
    lambda f: verify.initial_mismatch(modelled(f)).select("buoy_id", F.col("day").cast("string").alias("start_day"), "diff_init", "along_init", F.round("angle_init", 3).alias("angle_init")).distinct()
)
fq("g16_initial_speeds", f"SELECT buoy_id, day::VARCHAR AS start_day, {r(f'arg_min({SEEN}, lead_h) AS seen_init', f'arg_min({SAID}, lead_h) AS said_init')} FROM {MODELLED} GROUP BY buoy_id, day")(
    lambda f: verify.initial_speeds(modelled(f)).select("buoy_id", F.col("day").cast("string").alias("start_day"), "seen_init", "said_init").distinct()
)


def _enriched(f: DataFrame) -> DataFrame:
    """Runs matched with a second reading of the velocities, which is up to 44 s off."""
    off = (F.col("fix_id") * 37) % 90 - 45
    seen = tracks.legs(f).select("buoy_id", "fix_id", F.timestamp_micros(F.unix_micros("ts") + off * 1_000_000).alias("seen_ts"), "u", "v")
    runs = views.runs(f).drop("start_ts").withColumns({"mu": F.sin(F.col("fix_id") % 50), "mv": F.cos(F.col("fix_id") % 50) / 2})
    return verify.enrich(runs, seen, OBS_TOLERANCE_S).select("buoy_id", "fix_id", F.expr("unix_micros(start_ts) div 60000000").alias("minute"), "lat_init", "diff_init")


fq("g6_enriched", f"""SELECT buoy_id, fix_id, minute, {r('arg_min(lat_true, lead_h) OVER w AS lat_init', f'arg_min({DIFF}, lead_h) OVER w AS diff_init')} FROM (
  SELECT n.buoy_id, n.fix_id, n.lead_h, n.lat_true, {START_MINUTE} AS minute, m.o.u AS u, m.o.v AS v, sin(n.fix_id % 50) AS mu, cos(n.fix_id % 50) / 2 AS mv FROM runs n JOIN (
  SELECT f.fix_id, arg_min({{'u': o.u, 'v': o.v}}, (abs(o.us - epoch_us(f.ts)), o.us, CASE WHEN o.us <= epoch_us(f.ts) THEN -o.fix_id ELSE o.fix_id END)) AS o FROM fixes f LEFT JOIN
  (SELECT buoy_id, fix_id, u, v, epoch_us(ts) + ((fix_id * 37) % 90 - 45) * 1000000 AS us FROM legs) o ON f.buoy_id = o.buoy_id AND abs(o.us - epoch_us(f.ts)) <= {OBS_TOLERANCE_S}000000 GROUP BY f.fix_id) m USING (fix_id))
  WINDOW w AS (PARTITION BY buoy_id, minute)""")(_enriched)


def _surface_check(f: DataFrame, made: Callable[[DataFrame], DataFrame] = surface) -> DataFrame:
    rows = verify.first_in_window(errors(f), 68, 76)
    return verify.against_surface(verify.binned_quantile(rows, "diff_init", "lat_init", SPEED_EDGES, LAT_EDGES, 0.7), made(f), 72, 0.7)


_CASE = {n: "CASE " + " ".join(f"WHEN {c} > {lo!r} AND {c} <= {hi!r} THEN {i}" for i, (lo, hi) in enumerate(zip(e[:-1], e[1:], strict=True))) + " END" for n, c, e in (("ix", "diff_init", SPEED_EDGES), ("iy", "lat_init", LAT_EDGES))}
_BINNED = f"""(SELECT ix, iy, n, x, y, quantile, b0 + b_speed * x + b_lat * y AS predicted FROM (SELECT {_CASE['ix']} AS ix, {_CASE['iy']} AS iy, count(*) AS n, avg(diff_init) AS x, avg(lat_init) AS y, quantile_cont(error_km, 0.7) AS quantile
  FROM (SELECT *, row_number() OVER (PARTITION BY buoy_id, start_ts ORDER BY lead_h) AS k FROM {RANKED} WHERE lead_h > 68) WHERE k = 1 AND lead_h < 76 GROUP BY 1, 2), {SURFACE} WHERE lead_h = 72 AND q = 0.7 AND ix IS NOT NULL AND iy IS NOT NULL)"""
fq("r8_g17_surface_comparison", f"SELECT ix, iy, n, {r('x', 'y', 'quantile', 'predicted', '(predicted - quantile) / nullif(quantile, 0) AS relative')} FROM {_BINNED}")(
    lambda f: _surface_check(f).select("ix", "iy", "n", "x", "y", "quantile", "predicted", "relative")
)
fq("r8_r_squared", f"SELECT {r('1 - sum(pow(quantile - predicted, 2)) / sum(pow(quantile - m, 2)) AS r2')} FROM (SELECT *, avg(quantile) OVER () AS m FROM {_BINNED})")(lambda f: verify.r_squared(_surface_check(f), "quantile", "predicted"))


def _cones(f: DataFrame, made: Callable[[DataFrame], DataFrame] = surface) -> DataFrame:
    """Radii at the run's own leads, from the surface at any lead."""
    runs = errors(f).select("buoy_id", "day", "fix_id", "lead_h", "lat_fc", "lon_fc", "lat_init", "diff_init")
    return verify.uncertainty_at(runs, made(f)).select("buoy_id", F.col("day").cast("string").alias("start_day"), "fix_id", "q", "radius_km", "radius_deg")


fq("h10_quantile_surface")(fitted)
fq("r8_fitted_surface")(lambda f: _surface_check(f, fitted).select("ix", "iy", "n", "x", "y", "quantile", "predicted", "relative"))
fq("r9_fitted_cones")(lambda f: _cones(f, fitted))

_SEGMENTS = f"""(SELECT *, lead(lead_h) OVER w AS x1, lead(b0) OVER w AS c0, lead(b_speed) OVER w AS c1, lead(b_lat) OVER w AS c2, row_number() OVER w AS k, count(*) OVER (PARTITION BY q) AS n FROM {SURFACE} WINDOW w AS (PARTITION BY q ORDER BY lead_h))"""
_MIXED = [f"s.{a} + (s.{b} - s.{a}) * (p.lead_h - s.lead_h) / (s.x1 - s.lead_h)" for a, b in (("b0", "c0"), ("b_speed", "c1"), ("b_lat", "c2"))]
_ON = f"FROM {RANKED} p JOIN {_SEGMENTS} s ON s.x1 IS NOT NULL AND (s.k = 1 OR p.lead_h >= s.lead_h) AND (s.k = s.n - 1 OR p.lead_h < s.x1)"
fq("e8_coefficients_at", f"SELECT p.buoy_id, p.day::VARCHAR AS start_day, p.fix_id, s.q, {r(_MIXED[0] + ' AS b0', _MIXED[1] + ' AS b_speed')} {_ON}")(
    lambda f: resample.coefficients_at(errors(f), surface(f), values=["b0", "b_speed"]).select("buoy_id", F.col("day").cast("string").alias("start_day"), "fix_id", "q", "b0", "b_speed")
)
fq("r9_g23_cones", f"""SELECT buoy_id, start_day, fix_id, q, {r('km AS radius_km', 'km / 111 AS radius_deg')} FROM (SELECT p.buoy_id, p.day::VARCHAR AS start_day, p.fix_id, s.q,
  greatest(0.01, {_MIXED[0]} + ({_MIXED[1]}) * p.diff_init + ({_MIXED[2]}) * p.lat_init) AS km {_ON})""")(_cones)
fq("e9_nearest_lead", f"""SELECT buoy_id, day::VARCHAR AS start_day, fix_id, least(greatest(ceil((lead_h - 2) / 4) * 4, lo), hi) AS nearest_lead_h FROM runs, (SELECT (min(bin) + 1) * 4.0::DOUBLE AS lo, (max(bin) + 1) * 4.0::DOUBLE AS hi FROM binned)""")(
    lambda f: resample.nearest_row(forecast.leads(f).withColumnRenamed("lead_h", "p"), surface(f), "p", "lead_h").select("buoy_id", F.col("day").cast("string").alias("start_day"), "fix_id", "nearest_lead_h")
)

# -- resampling, alignment, blending


def _half_hours(f: DataFrame) -> DataFrame:
    """Errors of each run at its own leads and on every half day, in microseconds."""
    one = verify.position_error(views.runs(f)).withColumn("x", F.round(F.col("lead_h") * 3.6e9).cast("long"))
    return resample.dense_grid(one, ["buoy_id", "day"], "x", ["error_km"], 43_200_000_000).select("buoy_id", F.col("day").cast("string").alias("start_day"), "x", "error_km")


fq("e6_dense_leads", f"""SELECT buoy_id, start_day, x, {r('y AS error_km')} FROM (
  WITH own AS (SELECT buoy_id, day::VARCHAR AS start_day, round(lead_h * 3.6e9)::BIGINT AS x, min(error_km) AS y FROM errors GROUP BY ALL),
  seg AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM own WINDOW w AS (PARTITION BY buoy_id, start_day ORDER BY x))
  SELECT buoy_id, start_day, x, y FROM own UNION ALL
  SELECT buoy_id, start_day, t, y + (y1 - y) * (t - x) / (x1 - x) FROM (SELECT *, unnest(range(x // 43200000000 + 1, (x1 - 1) // 43200000000 + 1)) * 43200000000 AS t FROM seg WHERE x1 IS NOT NULL))""")(_half_hours)
fq("f6_aligned", f"""SELECT run_id, fix_id, {r('(epoch_us(ts) - first) / 3.6e9 AS lead_h', 'lon_fc', 'lat_fc')} FROM (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY run_id) AS first FROM (SELECT * FROM (
  SELECT *, lead(inside) OVER (PARTITION BY run_id ORDER BY ts, fix_id) AS nx FROM (SELECT t.buoy_id AS run_id, t.fix_id, t.ts, t.ts > b.a AND t.ts < b.z AS inside,
  CASE WHEN t.ts > b.a AND t.ts < b.z THEN p.lon + 0.25 + (coalesce(n.lon - p.lon, 0)) * coalesce((epoch_us(t.ts) - epoch_us(p.ts)) / nullif(epoch_us(n.ts) - epoch_us(p.ts), 0), 0) END AS lon_fc,
  CASE WHEN t.ts > b.a AND t.ts < b.z THEN p.lat - 0.5 + (coalesce(n.lat - p.lat, 0)) * coalesce((epoch_us(t.ts) - epoch_us(p.ts)) / nullif(epoch_us(n.ts) - epoch_us(p.ts), 0), 0) END AS lat_fc
  FROM fixes t JOIN (SELECT buoy_id, min(ts) AS a, max(ts) AS z FROM fixes WHERE fix_id % 3 = 0 GROUP BY buoy_id) b ON b.buoy_id = t.buoy_id
  ASOF LEFT JOIN (SELECT * FROM fixes WHERE fix_id % 3 = 0) p ON p.buoy_id = t.buoy_id AND p.ts <= t.ts
  ASOF LEFT JOIN (SELECT * FROM fixes WHERE fix_id % 3 = 0) n ON n.buoy_id = t.buoy_id AND n.ts >= t.ts)) WHERE inside OR (nx AND NOT inside)))""")(
    lambda f: forecast.align(f.withColumnRenamed("buoy_id", "run_id"), second_track(f)).select("run_id", "fix_id", "lead_h", "lon_fc", "lat_fc")
)


def _faded(f: DataFrame) -> DataFrame:
    """Hourly steps, one for each fix of a track, from its first leg's velocity to that of each fix."""
    w = Window.partitionBy("buoy_id").orderBy("ts", "fix_id")
    own = tracks.legs(f).where("u is not null and v is not null").withColumn("step", F.row_number().over(w))
    first = {n: F.first(c).over(w) for n, c in (("u0", "u"), ("v0", "v"), ("lon0", "lon"), ("lat0", "lat"))}
    steps = own.withColumns(first).select(F.col("buoy_id").alias("run_id"), "fix_id", "step", *first, "u", "v")
    return forecast.damped_persistence(steps, 3600.0).select("run_id", "fix_id", "lon", "lat")


_P = "(CASE WHEN step <= 4 * 0.83 * 24 THEN exp(-step / (0.83 * 24)) ELSE 0 END)"
fq("f7_damped_persistence", f"""SELECT buoy_id AS run_id, fix_id, {r(*[f'{c}0 + sum(({_P} * {v}0 + (1 - {_P}) * {v}) * 3600 / 111000) OVER (PARTITION BY buoy_id ORDER BY step) AS {c}' for c, v in (('lon', 'u'), ('lat', 'v'))])}
  FROM (SELECT buoy_id, fix_id, u, v, row_number() OVER w AS step, first_value(u) OVER w AS u0, first_value(v) OVER w AS v0, first_value(lon) OVER w AS lon0, first_value(lat) OVER w AS lat0
  FROM legs WHERE u IS NOT NULL AND v IS NOT NULL WINDOW w AS (PARTITION BY buoy_id ORDER BY ts, fix_id))""")(_faded)

# -- fields

_MONTHLY = "(SELECT (fix_id % 12 + 1)::INT AS month, floor(lat * 2) / 2 AS lat, floor(lon * 2) / 2 AS lon, avg((fix_id % 101 - 50) / 63.0::DOUBLE) AS u, avg((fix_id % 89 - 44) / 61.0::DOUBLE) AS v FROM fixes GROUP BY ALL)"
fq("b5_daily_climatology", f"""SELECT d::DATE::VARCHAR AS on_day, {r('lat', 'lon', 'u + (u1 - u) * date_diff(\'day\', s, d::DATE) / date_diff(\'day\', s, s1) AS u', 'v + (v1 - v) * date_diff(\'day\', s, d::DATE) / date_diff(\'day\', s, s1) AS v')} FROM (
  SELECT *, unnest(generate_series(s::TIMESTAMP, s1::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM (SELECT *, lead(s) OVER w AS s1, lead(u) OVER w AS u1, lead(v) OVER w AS v1 FROM (
  SELECT make_date(2024, month, 15) AS s, lat, lon, u, v FROM {_MONTHLY} UNION ALL SELECT DATE '2023-12-15', lat, lon, u, v FROM {_MONTHLY} WHERE month = 12 UNION ALL SELECT DATE '2025-01-15', lat, lon, u, v FROM {_MONTHLY} WHERE month = 1)
  WINDOW w AS (PARTITION BY lat, lon ORDER BY s)) WHERE s1 IS NOT NULL) WHERE year(d) = 2024""")(
    lambda f: field.daily_climatology(monthly(f), 2024).select(F.col("day").cast("string").alias("on_day"), "lat", "lon", "u", "v")
)
MEANS = {"u": complex(0.125, -0.25), "w": complex(0.5, 0.75), "s": complex(-0.125, 0.25)}
M, N, S = complex(0.75, 0.25), complex(0.0625, -0.03125), complex(0.5, 0.125)
_THREE = "(SELECT *, v * 2 AS uw, u - 1 AS vw, u / 4 AS ust, v / 8 AS vst FROM sampled)"


def _times(c: complex, re: str, im: str) -> tuple[str, str]:
    return f"({c.real} * ({re}) - ({c.imag}) * ({im}))", f"({c.real} * ({im}) + ({c.imag}) * ({re}))"


def _sum_sql(*parts: tuple[str, str]) -> tuple[str, str]:
    return " + ".join(p[0] for p in parts), " + ".join(p[1] for p in parts)


def _less(re: str, im: str, c: complex) -> tuple[str, str]:
    return f"{re} - ({c.real})", f"{im} - ({c.imag})"


_BIAS = _sum_sql(_times(M, *_less("u", "v", MEANS["u"])), _times(N, *_less("uw", "vw", MEANS["w"])), _times(S, *_less("ust", "vst", MEANS["s"])), (str(MEANS["u"].real), f"({MEANS['u'].imag})"))
_PLAIN = _sum_sql(("u", "v"), _times(S, "ust", "vst"), _times(N, *_less("uw", "vw", MEANS["w"])))
_WAVE = _times(S, "ust", "vst")
_STATIC = _sum_sql(_times(M, f"u + {_WAVE[0]}", f"v + {_WAVE[1]}"), _times(N, "uw", "vw"))
for _kind, _sql, _options in (("bias", _BIAS, {}), ("plain", _PLAIN, {"bias": False}), ("static", _STATIC, {"static": True})):
    fq(f"b8_corrected_{_kind}", f"SELECT epoch_us(time) // 1000000 AS t, {r('lat', 'lon', _sql[0] + ' AS cu', _sql[1] + ' AS cv')} FROM {_THREE}")(
        lambda f, _o=_options: field.corrected(three_products(f), MEANS, M, N, S, **_o).select(_at().alias("t"), "lat", "lon", "cu", "cv")
    )
fq("b9_daily_snapshots", f"""SELECT epoch_us(start) // 1000000 AS start, epoch_us(time) // 1000000 AS t, {r('lat', 'lon', 'u')} FROM (SELECT d.start, arg_min(a.time, (abs(epoch_us(a.time) - epoch_us(d.start)), a.time)) AS time
  FROM (SELECT DISTINCT date_trunc('day', ts) + INTERVAL 5 HOUR AS start FROM fixes) d, (SELECT DISTINCT time FROM sampled WHERE day(time) % 3 = 0) a GROUP BY d.start) JOIN sampled USING (time)""")(
    lambda f: field.daily_snapshots(views.sampled_field(f).where(F.dayofmonth("time") % 3 == 0), f.select((F.date_trunc("day", "ts") + F.expr("INTERVAL 5 HOURS")).alias("start")).distinct()).select(_at("start").alias("start"), _at().alias("t"), "lat", "lon", "u")
)

# -- binning

LON_BINS, LAT_BINS = (-164.25, 0.5, 8), (4.25, 0.5, 8)
_HIST = "(SELECT least(floor((lon + 164.25) / 0.5), 7)::INT AS ix, least(floor((lat - 4.25) / 0.5), 7)::INT AS iy, count(*) AS n FROM fixes WHERE lon BETWEEN -164.25 AND -160.25 AND lat BETWEEN 4.25 AND 8.25 GROUP BY 1, 2)"


def _slope_sql(axis: str, low: float) -> str:
    means = f"SELECT i AS bin, coalesce(sum(n), 0) / 8.0::DOUBLE AS m FROM (SELECT unnest(range(8)) AS i) LEFT JOIN {_HIST} ON i = {axis} GROUP BY i"
    return f"""SELECT '{axis}' AS axis, {r('regr_slope(y, x) AS slope', 'regr_intercept(y, x) AS intercept')} FROM (SELECT {low} + bin * 0.5 AS x, CASE WHEN row_number() OVER (ORDER BY m DESC, bin) = 1 THEN avg(m) OVER () ELSE m END AS y FROM ({means}))"""


fq("h12_marginal_slopes", _slope_sql("ix", -164.25) + " UNION ALL " + _slope_sql("iy", 4.25))(lambda f: bins.marginal_slopes(bins.histogram2d(f, "lon", "lat", LON_BINS, LAT_BINS), LON_BINS, LAT_BINS))
fq("h15_density_band", f"""SELECT iy, {r('avg(m) AS mean', 'quantile_cont(m, 0.95) AS high')} FROM (SELECT iy, resample, sum(coalesce(n, 0)) / 8.0::DOUBLE / 2 AS m FROM
  (SELECT resample, {drawn('resample', 'draw', '8')} AS ix FROM (SELECT unnest(range(100)) AS resample), (SELECT unnest(range(8)) AS draw)) d CROSS JOIN (SELECT unnest(range(8)) AS iy) LEFT JOIN {_HIST} USING (ix, iy) GROUP BY ALL) GROUP BY iy""")(
    lambda f: bootstrap.density_band(bins.histogram2d(f, "lon", "lat", LON_BINS, LAT_BINS), bootstrap.draws(f.sparkSession, 100, 8), LAT_BINS[2], 8, years=2.0)
)

# -- reports


def _activity(f: DataFrame) -> DataFrame:
    """Buoys in their latest segment on a day, where they were last, and how many were active that day."""
    late = selection.latest_segments(f, "2024-01-20")
    last = late.groupBy("buoy_id").agg(F.count("*").alias("n"), F.max("day").alias("day")).join(selection.last_fixes(late), "buoy_id")
    return last.join(selection.active_by_observation(f).select("day", "active"), "day").select("buoy_id", "n", "lon", "lat", "active")


fq("r1_activity", f"""SELECT buoy_id, n, {r('lon', 'lat')}, active FROM (SELECT buoy_id, count(*) AS n, arg_max(lon, (ts, fix_id)) AS lon, arg_max(lat, (ts, fix_id)) AS lat, max(day) AS d FROM (
  SELECT *, max(segment) OVER (PARTITION BY buoy_id) AS top FROM (SELECT *, sum(CASE WHEN day - before >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) AS segment FROM (
  SELECT *, lag(day) OVER (PARTITION BY buoy_id ORDER BY ts, fix_id) AS before FROM ({D8})))) WHERE segment = top GROUP BY buoy_id)
  JOIN (SELECT ts::DATE AS d, count(DISTINCT buoy_id) AS active FROM fixes GROUP BY ts::DATE) USING (d)""")(_activity)


def _profiles(f: DataFrame) -> DataFrame:
    """Seasonal latitude profiles of the drift beside the gridded field's (R2)."""
    band = (F.floor(F.col("lat") * 2) / 2).alias("lat")
    drift = tracks.clean(f).groupBy(F.year("ts").alias("year"), F.quarter("ts").alias("quarter"), band).agg(F.avg("u").alias("drift_u"))
    return drift.join(field.quarterly_profile(views.sampled_field(f)).withColumnRenamed("u", "field_u"), ["year", "quarter", "lat"], "full")


fq("r2_profiles", f"""SELECT year, quarter, {r('lat', 'drift_u', 'field_u')} FROM (SELECT year(ts)::INT AS year, quarter(ts)::INT AS quarter, floor(lat * 2) / 2 AS lat, avg(u) AS drift_u FROM cleaned GROUP BY ALL)
  FULL JOIN (SELECT year(time)::INT AS year, quarter(time)::INT AS quarter, lat, avg(u) AS field_u FROM zonal GROUP BY ALL) USING (year, quarter, lat)""")(_profiles)


def _acf_curve(f: DataFrame) -> DataFrame:
    """Mean autocorrelation with its band, on quarter hours."""
    acf, draws = by_time(spectra.acf_job(tracks.legs(f)))
    curve = bootstrap.over_blocks(acf, "block", ["lag"], "r", draws).withColumn("us", F.col("lag").cast("long") * 4 * 3_600_000_000)
    return resample.regular(curve, [], "us", ["mean", "low", "high"], 900_000_000, clamp=False)


def _coherence(f: DataFrame) -> DataFrame:
    """Coherence of u and v by frequency with its band."""
    cross = spectra.cross_spectra(spectra.chunks(spectra.split_at_gaps(tracks.legs(f), 72), 4, 7), ["buoy_id", "start_us"], "u", "v", 42)
    blocks, draws = by_time(cross)
    band = bootstrap.coherence_band(blocks, "block", draws)
    return spectra.coherence(cross).join(band.withColumnRenamed("mean", "drawn"), "k")


fq("r3_e7_acf_curve")(_acf_curve)
fq("r4_coherence")(_coherence)


def by_model(f: DataFrame) -> DataFrame:
    """Errors of two forecasts of all runs, with a model column."""
    columns = ["model", "buoy_id", "start_ts", "lead_h", "lat_true", "lon_true", "error_km"]
    both = {"no_motion": views.runs(f), "persistence": forecast.persistence(f)}
    parts = [verify.position_error(df).withColumn("model", F.lit(m)).select(*columns) for m, df in both.items()]
    return parts[0].unionByName(parts[1])


_PERSISTENCE = f"""SELECT 'persistence', lead_h, {hav('lat_true', 'lon_true', '(lat_fc + vlat * lead_h * 3600)', '(lon_fc + vlon * lead_h * 3600)')} FROM still s JOIN (SELECT buoy_id, ts AS start_ts, coalesce(dx_deg / nullif(dt_s, 0), 0) AS vlon,
  coalesce(dy_deg / nullif(dt_s, 0), 0) AS vlat, row_number() OVER (PARTITION BY buoy_id, ts ORDER BY fix_id) AS k FROM legs) v ON s.buoy_id = v.buoy_id AND s.start_ts = v.start_ts AND k = 1"""
fq("r5_growth_by_model", f"""SELECT model, bin, coalesce(n, 0) AS n, rmse, q30, q90 FROM (SELECT model, unnest(range(48))::INT AS bin FROM (SELECT unnest(['no_motion', 'persistence']) AS model)) LEFT JOIN (
  SELECT model, (ceil(lead_h / 4) - 1)::INT AS bin, count(*) AS n, {r('sqrt(avg(error_km * error_km)) AS rmse', 'quantile_cont(error_km, 0.3) AS q30', 'quantile_cont(error_km, 0.9) AS q90')}
  FROM (SELECT 'no_motion' AS model, lead_h, error_km FROM errors UNION ALL {_PERSISTENCE}) WHERE lead_h > 0 AND lead_h <= 192 GROUP BY 1, 2) USING (model, bin)""")(
    lambda f: verify.by_lead(by_model(f), keys=["model"]).select("model", "bin", F.coalesce("n", F.lit(0)).alias("n"), "rmse", "q30", "q90")
)


def _model_table(f: DataFrame) -> DataFrame:
    """Fit, phase and error after a week of two forcings; the corrected error is that of persistence."""
    made = {"w_re": F.col("u") * 2 + (F.col("fix_id") % 13) / 8.0, "w_im": F.col("v") - (F.col("fix_id") % 7) / 4.0, "s_re": (F.col("fix_id") % 11) / 3.0, "s_im": (F.col("fix_id") % 17) / 5.0}
    fits = cregress.sweep(tracks.clean(f).withColumns(made), ("u", "v"), {"current": ("w_re", "w_im"), "wave": ("s_re", "s_im")}, {"turn": ("w_im", "s_re")})
    each = F.explode(F.array(F.lit("current"), F.lit("wave"))).alias("model")
    raw, corrected = (verify.position_error(df).select("lead_h", "error_km", each) for df in (views.runs(f), forecast.persistence(f)))
    return verify.model_table(fits, raw, corrected)


fq("r6_g22_model_table")(_model_table)
fq("r7_error_by_mismatch", f"""SELECT least(ceil((x - lo) / ((hi - lo) / 19)) - 1, 18)::INT AS bin, {r('avg(error_km) AS error_km')}, count(*) AS n FROM
  (SELECT diff_init AS x, error_km, min(diff_init) OVER () AS lo, max(diff_init) OVER () AS hi FROM {RANKED} WHERE lead_h > 68 AND lead_h <= 72) WHERE x > lo GROUP BY 1""")(lambda f: verify.error_by_predictor(errors(f), "diff_init", 17))


def _yearly(f: DataFrame) -> DataFrame:
    """Daily error, variance of the drift and the field's zero crossing."""
    error = verify.daily_error(verify.position_error(views.runs(f)), 17).select("day", "error_km", F.col("rolling").alias("error_rolling"))
    spread = verify.daily_variance(tracks.legs(f)).select("day", "variance", F.col("rolling").alias("variance_rolling"))
    crossing = field.zero_crossing(views.sampled_field(f)).select(F.to_date("time").alias("day"), "lat")
    return error.join(spread, "day", "left").join(crossing, "day", "left").withColumn("day", F.col("day").cast("string")).withColumnRenamed("day", "on_day")


fq("r10_yearly_variability", f"""SELECT day::VARCHAR AS on_day, {r('e AS error_km', 'avg(e) OVER (ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS error_rolling', 'variance', 'variance_rolling', 'lat')} FROM (SELECT day, avg(error_km) AS e FROM binned WHERE bin = 17 GROUP BY day)
  LEFT JOIN (SELECT day, x AS variance, CASE WHEN count(x) OVER w >= 10 THEN avg(x) OVER w END AS variance_rolling FROM (SELECT ts::DATE AS day, var_samp(u) + var_samp(v) AS x FROM legs GROUP BY ts::DATE) WINDOW w AS (ORDER BY day ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)) USING (day)
  LEFT JOIN (SELECT time::DATE AS day, min(lat + (l1 - lat) * (-u) / (u1 - u)) FILTER (u < 0 AND u1 >= 0) AS lat FROM (SELECT *, lead(u) OVER w AS u1, lead(lat) OVER w AS l1 FROM zonal WINDOW w AS (PARTITION BY time ORDER BY lat)) GROUP BY time) USING (day)""")(_yearly)
