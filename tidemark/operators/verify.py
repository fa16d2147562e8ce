"""Verification of forecasts (buoy_id, start_ts, ts, lead_h, lat_true, lon_true, lat_fc, lon_fc)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bins import edge_bin, equal_bin
from tidemark.functions.geo import haversine_km
from tidemark.operators.asof import nearest
from tidemark.operators.resample import coefficients_at
from tidemark.operators.quantiles import select

LEAD_STEP, LEAD_BINS = 4.0, 48
RUN = ["buoy_id", "start_ts"]


def _floored(x: Column, least: float = 0.0) -> Column:
    """x, at least ``least``; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(least), x))


def start_time(ts: Column, lead_h: Column) -> Column:
    """Start of a run: time less lead, to the nearest minute, half minutes to even (G1)."""
    micros = F.unix_micros(ts.cast("timestamp")) - F.round(lead_h * 3.6e9).cast("long")
    return F.timestamp_micros((F.bround(micros / 60_000_000) * 60_000_000).cast("long"))


def first_known(column: str, by: str = "lead_h") -> Column:
    """A run's first value that is not null."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(by))).over(Window.partitionBy(*RUN))


def position_error(df: DataFrame) -> DataFrame:
    """Distance of forecast and truth in km."""
    return df.withColumn("error_km", haversine_km(F.col("lat_true"), F.col("lon_true"), F.col("lat_fc"), F.col("lon_fc")))


def initial_position(df: DataFrame) -> DataFrame:
    """The run's first truth."""
    return df.withColumns({"lat_init": first_known("lat_true"), "lon_init": first_known("lon_true")})


def initial_mismatch(df: DataFrame) -> DataFrame:
    """Size of the first difference of model and observed velocity, and how the model lies to the observed.

    Needs u, v (observed) and mu, mv (model).
    """
    seen, said = F.hypot("u", "v"), F.hypot("mu", "mv")
    dot = F.col("u") * F.col("mu") + F.col("v") * F.col("mv")
    ratio = F.try_divide(F.try_divide(dot, seen), said)
    cosine = F.when(ratio.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio)))
    out = df.withColumns({"_diff": F.hypot(F.col("mu") - F.col("u"), F.col("mv") - F.col("v")), "_along": F.try_divide(dot, seen), "_angle": F.degrees(F.acos(cosine))})
    return out.withColumns({"diff_init": first_known("_diff"), "along_init": first_known("_along"), "angle_init": first_known("_angle")}).drop("_diff", "_along", "_angle")


def initial_speeds(df: DataFrame) -> DataFrame:
    """The run's first observed and first modelled speed."""
    out = df.withColumns({"_seen": F.hypot("u", "v"), "_said": F.hypot("mu", "mv")})
    return out.withColumns({"seen_init": first_known("_seen"), "said_init": first_known("_said")}).drop("_seen", "_said")


def enrich(df: DataFrame, seen: DataFrame, tolerance_s: float, bucket_s: int | None = None) -> DataFrame:
    """Forecasts (buoy_id, ts, lead_h, positions, mu, mv) with the nearest reading of u and v, the run's start and first values.

    ``seen`` is (buoy_id, fix_id, seen_ts, u, v). The start comes from time and lead, to the minute; runs are told
    apart by it.
    """
    matched = nearest(df, seen, ["buoy_id"], "ts", "seen_ts", ["u", "v"], tolerance_s, bucket_s=bucket_s)
    return initial_mismatch(initial_position(matched.withColumn("start_ts", start_time(F.col("ts"), F.col("lead_h")))))


def skill_displacement(df: DataFrame) -> DataFrame:
    """1 - error / distance of the forecast from the start, at least 0."""
    far = haversine_km(F.col("lat_init"), F.col("lon_init"), F.col("lat_fc"), F.col("lon_fc"))
    return df.withColumn("skill", _floored(1 - F.try_divide(F.col("error_km"), far)))


def skill_path(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """1 - error / length of the truth's path so far (110 km a degree), at least 0 (G9); ``keys`` tell runs of one start apart."""
    w = Window.partitionBy(*(keys or []), *RUN).orderBy("lead_h")
    step = F.hypot(F.col("lat_true") - F.lag("lat_true").over(w), F.col("lon_true") - F.lag("lon_true").over(w)) * 110
    out = df.withColumn("_step", step).withColumn("path_km", F.sum("_step").over(w)).drop("_step")
    return out.withColumn("skill", _floored(1 - F.try_divide(F.col("error_km"), F.nullif("path_km", F.lit(0.0)))))


def lead_bin(lead_h: Column, step: float = LEAD_STEP, n: int = LEAD_BINS) -> Column:
    """Number of the right-closed lead bin; lead 0 is in none."""
    return equal_bin(lead_h, 0.0, step, n)


def by_lead(df: DataFrame, step: float = LEAD_STEP, n: int = LEAD_BINS, quantiles: tuple = (0.3, 0.9), keys: list[str] | None = None, approximate: bool = False, few: int | None = None) -> DataFrame:
    """RMSE and quantiles of the error for each lead bin; empty bins stay, with nulls.

    Plain percentiles hold a bin's distinct errors in one task; with ``few`` they come by selection (quantiles.select).
    """
    keys = keys or []
    q = F.percentile_approx if approximate else F.percentile
    binned = df.withColumn("bin", lead_bin(F.col("lead_h"), step, n)).where(F.col("bin").isNotNull() & F.col("error_km").isNotNull())
    inside = [] if few else [q("error_km", F.lit(x)).alias(f"q{int(x * 100)}") for x in quantiles]
    got = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.sqrt(F.avg(F.col("error_km") * F.col("error_km"))).alias("rmse"), *inside)
    if few:
        chosen = select(binned, [*keys, "bin"], "error_km", quantiles, few).drop("n")
        got = got.join(chosen, [*keys, "bin"], "left").withColumns({f"q{int(x * 100)}": F.get("quantiles", F.lit(i)) for i, x in enumerate(quantiles)}).drop("quantiles")
    spark = df.sparkSession
    bins = spark.range(n).select(F.col("id").cast("int").alias("bin"))
    if keys:
        bins = df.select(*keys).distinct().join(F.broadcast(bins))
    return bins.join(got, [*keys, "bin"], "left").withColumns({"lead_lo": F.col("bin") * step, "lead_hi": (F.col("bin") + 1) * step})


def mean_skill(df: DataFrame, step: float = LEAD_STEP, n: int = LEAD_BINS, keys: list[str] | None = None) -> DataFrame:
    """Mean path skill for each lead bin, with a 0 at lead 0, of all rows or for each of ``keys``."""
    keys = keys or []
    means = df.withColumn("bin", lead_bin(F.col("lead_h"), step, n)).where("bin is not null").groupBy(*keys, "bin").agg(F.avg("skill").alias("skill"))
    each = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    zero = each.select(*keys, F.lit(0.0).alias("lead_hi"), F.lit(0.0).alias("skill"))
    return zero.union(means.select(*keys, (F.col("bin") + 1) * step, "skill"))


def rmse_at(df: DataFrame, lead: float, width: float = 2.0, keys: list[str] | None = None) -> DataFrame:
    """RMSE within an open interval around one lead."""
    near = df.where((F.col("lead_h") > lead - width) & (F.col("lead_h") < lead + width))
    return near.groupBy(*(keys or [])).agg(F.sqrt(F.avg(F.col("error_km") * F.col("error_km"))).alias("rmse"), F.count("error_km").alias("n"))


def model_table(fits: DataFrame, raw: DataFrame, corrected: DataFrame, lead: float = 168.0) -> DataFrame:
    """(model, r, z, phase, second, rmse_raw, rmse_corrected): how each model fits and errs at one lead.

    ``fits`` comes from the model sweep (r_x, angle_x, z_x and c_turn); ``raw`` and ``corrected`` are errors with a model column.
    A model without errors at that lead stays, with nulls.
    """
    size = F.hypot("z_x_re", "z_x_im")
    out = fits.select("model", F.col("r_x").alias("r"), size.alias("z"), F.col("angle_x").alias("phase"), F.hypot("c_turn_re", "c_turn_im").alias("second"))
    for name, errors in (("rmse_raw", raw), ("rmse_corrected", corrected)):
        out = out.join(rmse_at(errors, lead, keys=["model"]).select("model", F.col("rmse").alias(name)), "model", "left")
    return out


def error_by_predictor(df: DataFrame, predictor: str, bin_: int, n: int = 19) -> DataFrame:
    """Mean error for equal bins of a predictor in one lead bin; the least value is in no bin."""
    rows = df.where(lead_bin(F.col("lead_h")) == bin_).select(F.col(predictor).alias("x"), "error_km").dropna()
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    number = equal_bin(F.col("x"), F.col("lo"), (F.col("hi") - F.col("lo")) / n, n + 1)
    placed = rows.join(F.broadcast(ends)).withColumn("bin", F.when(number.isNotNull(), F.least(number, F.lit(n - 1))))
    return placed.where("bin is not null").groupBy("bin").agg(F.avg("error_km").alias("error_km"), F.count("*").alias("n"))


def share_histogram(df: DataFrame, column: str, n: int = 19) -> DataFrame:
    """Per cent of values in n equal bins on [0, 1], the last closed."""
    got = df.select(equal_bin(F.col(column), 0.0, 1.0 / n, n, "both").alias("bin")).dropna().groupBy("bin").agg(F.count("*").alias("n"))
    return got.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def first_in_window(df: DataFrame, low: float, high: float) -> DataFrame:
    """One row for each run: the first after lead ``low``, if before ``high``."""
    w = Window.partitionBy(*RUN).orderBy("lead_h")
    return df.where(F.col("lead_h") > low).withColumn("_r", F.row_number().over(w)).where((F.col("_r") == 1) & (F.col("lead_h") < high)).drop("_r")


def binned_quantile(rows: DataFrame, x: str, y: str, x_edges: list[float], y_edges: list[float], q: float = 0.7) -> DataFrame:
    """(ix, iy, n, x, y, quantile): the error's quantile and mean place in each 2-D bin."""
    placed = rows.withColumns({"ix": edge_bin(F.col(x), x_edges), "iy": edge_bin(F.col(y), y_edges)}).where("ix is not null and iy is not null")
    return placed.groupBy("ix", "iy").agg(F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.percentile("error_km", F.lit(q)).alias("quantile"))


def r_squared(df: DataFrame, seen: str, said: str) -> DataFrame:
    """1 - residual / total sum of squares."""
    rows = df.select(F.col(seen).alias("y"), F.col(said).alias("f")).dropna()
    mean = rows.agg(F.avg("y").alias("m"))
    sums = rows.join(F.broadcast(mean)).agg(F.sum(F.pow(F.col("y") - F.col("f"), 2)).alias("a"), F.sum(F.pow(F.col("y") - F.col("m"), 2)).alias("b"))
    return sums.select((1 - F.try_divide("a", "b")).alias("r2"))


def against_surface(binned: DataFrame, surface: DataFrame, lead: float, q: float) -> DataFrame:
    """2-D bins with the surface's quantile at their mean place and its relative error."""
    plane = surface.where((F.col("lead_h") == lead) & (F.col("q") == q)).select("b0", "b_speed", "b_lat")
    out = binned.join(F.broadcast(plane)).withColumn("predicted", F.col("b0") + F.col("b_speed") * F.col("x") + F.col("b_lat") * F.col("y"))
    return out.withColumn("relative", F.try_divide(F.col("predicted") - F.col("quantile"), F.col("quantile"))).drop("b0", "b_speed", "b_lat")


def daily_error(df: DataFrame, bin_: int, rows: int = 30) -> DataFrame:
    """(day, error_km, rolling): mean error of a start day in one lead bin, and its centred mean."""
    days = df.where(lead_bin(F.col("lead_h")) == bin_).groupBy(F.to_date("start_ts").alias("day")).agg(F.avg("error_km").alias("error_km"))
    return days.withColumn("rolling", F.avg("error_km").over(Window.orderBy("day").rowsBetween(-(rows // 2), (rows - 1) // 2)))


def daily_variance(legs: DataFrame, rows: int = 30, least: int = 10) -> DataFrame:
    """(day, variance, rolling): sample variances of u and v added, and their centred mean over known days."""
    days = legs.groupBy(F.to_date("ts").alias("day")).agg((F.var_samp("u") + F.var_samp("v")).alias("variance"))
    w = Window.orderBy("day").rowsBetween(-(rows // 2), (rows - 1) // 2)
    return days.withColumn("rolling", F.when(F.count("variance").over(w) >= least, F.avg("variance").over(w)))


def lagged_correlation(left: DataFrame, right: DataFrame, x: str, y: str, lag: int = 3) -> DataFrame:
    """Correlation by day of x with y some rows earlier."""
    shifted = right.withColumn("_y", F.lag(y, lag).over(Window.orderBy("day"))).select("day", "_y")
    return left.join(shifted, "day", "left").agg(F.corr(x, "_y").alias("correlation"))


def uncertainty(runs: DataFrame, surface: DataFrame) -> DataFrame:
    """(run columns, lead_h, q, radius_km, radius_deg): error quantiles of runs from their first values.

    ``surface`` (lead_h, q, b0, b_speed, b_lat) is a table of coefficients.
    """
    radius = _floored(F.col("b0") + F.col("b_speed") * F.col("diff_init") + F.col("b_lat") * F.col("lat_init"), 0.01)
    out = runs.join(F.broadcast(surface)).withColumn("radius_km", radius)
    return out.withColumn("radius_deg", F.col("radius_km") / 111).drop("b0", "b_speed", "b_lat")


def uncertainty_at(runs: DataFrame, surface: DataFrame) -> DataFrame:
    """As uncertainty(), at the runs' own leads, the surface being linear between its leads and beyond them."""
    values = ["b0", "b_speed", "b_lat"]
    placed = coefficients_at(runs, surface, values=values)
    radius = _floored(F.col("b0") + F.col("b_speed") * F.col("diff_init") + F.col("b_lat") * F.col("lat_init"), 0.01)
    return placed.withColumn("radius_km", radius).withColumn("radius_deg", F.col("radius_km") / 111).drop(*values)
