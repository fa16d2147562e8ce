"""Complex-valued regression of velocities: all from sums of products, so any number of models is one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = tuple[Column, Column]


def conj_product(a: Z, b: Z) -> Z:
    """Conjugate of a, times b."""
    return a[0] * b[0] + a[1] * b[1], a[0] * b[1] - a[1] * b[0]


def product(a: Z, b: Z) -> Z:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def _pair(name: str) -> Z:
    return F.col(f"{name}_re"), F.col(f"{name}_im")


def _over(a: Z, b: Z) -> Z:
    size = b[0] * b[0] + b[1] * b[1]
    top = conj_product(b, a)
    return F.try_divide(top[0], size), F.try_divide(top[1], size)


def gram(df: DataFrame, target: tuple[str, str], predictors: dict[str, tuple[str, str]], keys: list[str] | None = None) -> DataFrame:
    """Means of target and predictors (m_*) and mean products of their anomalies (g_a_b), rows with a null left out.

    One aggregation of plain sums: the mean of conj(a') b' is the mean of conj(a) b less the product of the means.
    """
    keys = keys or []
    names = {"y": target, **predictors}
    rows = df.dropna(subset=[c for pair in names.values() for c in pair])
    z = {n: (F.col(c[0]), F.col(c[1])) for n, c in names.items()}
    sums = [F.count("*").alias("n")]
    for a in names:
        sums += [F.avg(z[a][0]).alias(f"m_{a}_re"), F.avg(z[a][1]).alias(f"m_{a}_im")]
        for b in names:
            re, im = conj_product(z[a], z[b])
            sums += [F.avg(re).alias(f"g_{a}_{b}_re"), F.avg(im).alias(f"g_{a}_{b}_im")]
    out = rows.groupBy(*keys).agg(*sums)
    fixes = {}
    for a in names:
        for b in names:
            re, im = conj_product(_pair(f"m_{a}"), _pair(f"m_{b}"))
            fixes[f"g_{a}_{b}_re"], fixes[f"g_{a}_{b}_im"] = F.col(f"g_{a}_{b}_re") - re, F.col(f"g_{a}_{b}_im") - im
    return out.withColumns(fixes)


def correlation(g: DataFrame, x: str) -> DataFrame:
    """Magnitude and angle (degrees) of the complex correlation of target and predictor (H1)."""
    re, im = _pair(f"g_y_{x}")
    size = F.sqrt(F.col("g_y_y_re") * F.col(f"g_{x}_{x}_re"))
    return g.withColumns({f"r_{x}": F.try_divide(F.hypot(re, im), size), f"angle_{x}": F.degrees(F.atan2(im, re))})


def scale(g: DataFrame, x: str) -> DataFrame:
    """Complex factor Z of a single predictor (H2)."""
    re, im = _over(_pair(f"g_{x}_y"), (F.col(f"g_{x}_{x}_re"), F.lit(0.0)))
    return g.withColumns({f"z_{x}_re": re, f"z_{x}_im": im})


def _det(m: list[list[Z]]) -> Z:
    if len(m) == 1:
        return m[0][0]
    total: Z = (F.lit(0.0), F.lit(0.0))
    for j in range(len(m)):
        part = product(m[0][j], _det([row[:j] + row[j + 1 :] for row in m[1:]]))
        total = (total[0] + part[0], total[1] + part[1]) if j % 2 == 0 else (total[0] - part[0], total[1] - part[1])
    return total


def least_squares(g: DataFrame, predictors: list[str]) -> DataFrame:
    """Coefficients c_* of up to three predictors on anomalies, without intercept (H3, H4).

    A predictor without variance gets coefficient 0: its equation is replaced by c = 0. Where predictors are
    collinear, the solution of least norm is taken, as the limit of a vanishing ridge.
    """
    dead = {x: F.col(f"g_{x}_{x}_re") <= 1e-15 for x in predictors}
    n = len(predictors)
    # entries and determinants are columns of their own, so that no expression holds another many times
    made = {}
    for i, a in enumerate(predictors):
        for j, b in enumerate(predictors):
            re, im = _pair(f"g_{a}_{b}")
            made |= {f"_l{i}{j}_re": F.when(dead[a], 1.0 if a == b else 0.0).otherwise(re), f"_l{i}{j}_im": F.when(dead[a], 0.0).otherwise(im)}
        re, im = _pair(f"g_{a}_y")
        made |= {f"_r{i}_re": F.when(dead[a], 0.0).otherwise(re), f"_r{i}_im": F.when(dead[a], 0.0).otherwise(im)}
    size, total = F.lit(1.0), F.lit(0.0)
    for i in range(n):
        size, total = size * F.col(f"_l{i}{i}_re"), total + F.col(f"_l{i}{i}_re")
    plain = [[_pair(f"_l{i}{j}") for j in range(n)] for i in range(n)]
    ridge = [[(z[0] + 1e-8 / n * F.col("_total"), z[1]) if i == j else z for j, z in enumerate(row)] for i, row in enumerate(plain)]
    dets = {}
    for name, matrix in (("p", plain), ("q", ridge)):
        columns = {"": matrix} | {str(j): [[_pair(f"_r{i}") if k == j else z for k, z in enumerate(row)] for i, row in enumerate(matrix)] for j in range(n)}
        for j, m in columns.items():
            dets[f"_{name}{j}_re"], dets[f"_{name}{j}_im"] = _det(m)
    out = g.withColumns(made).withColumns({"_size": size, "_total": total}).withColumns(dets)
    singular = F.abs(F.col("_p_re")) <= 1e-12 * F.col("_size")
    found = {}
    for j, x in enumerate(predictors):
        by_plain, by_ridge = (_over(_pair(f"_{name}{j}"), _pair(f"_{name}")) for name in "pq")
        found[f"c_{x}_re"], found[f"c_{x}_im"] = (F.when(singular, v).otherwise(u) for u, v in zip(by_plain, by_ridge, strict=True))
    return out.withColumns(found).drop(*made, *dets, "_size", "_total")


def apply(df: DataFrame, fit: DataFrame, predictors: dict[str, tuple[str, str]], keys: list[str] | None = None) -> DataFrame:
    """Fitted target: coefficients on anomalies, plus the target's mean (H5). ``fit`` is one row for each key."""
    keys = keys or []
    wanted = [*keys, "m_y_re", "m_y_im", *[f"{k}_{x}_{p}" for x in predictors for k in ("c", "m") for p in ("re", "im")]]
    joined = df.join(fit.select(*wanted), keys) if keys else df.join(F.broadcast(fit.select(*wanted)))
    re, im = _pair("m_y")
    for x, (a, b) in predictors.items():
        part = product(_pair(f"c_{x}"), (F.col(a) - F.col(f"m_{x}_re"), F.col(b) - F.col(f"m_{x}_im")))
        re, im = re + part[0], im + part[1]
    return joined.withColumns({"fit_u": re, "fit_v": im}).drop(*[c for c in wanted if c not in keys])


def apply_scale(df: DataFrame, fit: DataFrame, x: str, columns: tuple[str, str]) -> DataFrame:
    """Z on the predictor's anomaly, plus the predictor's mean (H6)."""
    joined = df.join(F.broadcast(fit.select(f"z_{x}_re", f"z_{x}_im", f"m_{x}_re", f"m_{x}_im")))
    part = product(_pair(f"z_{x}"), (F.col(columns[0]) - F.col(f"m_{x}_re"), F.col(columns[1]) - F.col(f"m_{x}_im")))
    return joined.withColumns({"fit_u": part[0] + F.col(f"m_{x}_re"), "fit_v": part[1] + F.col(f"m_{x}_im")}).drop(f"z_{x}_re", f"z_{x}_im", f"m_{x}_re", f"m_{x}_im")


def contribution(df: DataFrame, fit: DataFrame, predictors: dict[str, tuple[str, str]]) -> DataFrame:
    """Share of each predictor: size of its coefficient times its mean size, over all (H7)."""
    means = df.agg(*[F.avg(F.hypot(a, b)).alias(f"s_{x}") for x, (a, b) in predictors.items()])
    joined = means.join(fit.select(*[f"c_{x}_{p}" for x in predictors for p in ("re", "im")]))
    part = {x: F.hypot(*_pair(f"c_{x}")) * F.col(f"s_{x}") for x in predictors}
    total = sum(list(part.values())[1:], next(iter(part.values())))
    return joined.select(*[F.try_divide(v, total).alias(f"share_{x}") for x, v in part.items()])


def sweep(df: DataFrame, target: tuple[str, str], models: dict[str, tuple[str, str]], extra: dict[str, tuple[str, str]]) -> DataFrame:
    """For each model: its complex correlation, Z, and the fit with the extra predictors (H9). One aggregation.

    The models' columns are stacked to rows (model, x_u, x_v), so the number of models adds rows, not jobs.
    """
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(a).alias("x_u"), F.col(b).alias("x_v")) for m, (a, b) in models.items()]))
    long = df.select(*target, *[c for p in extra.values() for c in p], stacked.alias("m")).select("*", "m.*").drop("m")
    g = gram(long, target, {"x": ("x_u", "x_v"), **extra}, ["model"])
    return least_squares(scale(correlation(g, "x"), "x"), ["x", *extra])


def nearest_depth(configs: DataFrame, depths: list[float]) -> DataFrame:
    """``configs`` with matched_depth, the one of ``depths`` nearest to depth, of two as near the first listed (H8)."""
    options = F.array(*[F.struct(F.abs(F.col("depth") - d).alias("d"), F.lit(i).alias("i"), F.lit(float(d)).alias("at")) for i, d in enumerate(depths)])
    return configs.withColumn("matched_depth", F.array_min(options)["at"])


def bias_coefficients(df: DataFrame, target: tuple[str, str], currents: dict[float, tuple[str, str]], wind: tuple[str, str], stokes: tuple[str, str], configs: DataFrame) -> DataFrame:
    """Coefficients and means for each of ``configs`` (config, depth, use_current, use_wind, use_stokes) (H8).

    A configuration takes the current mapped at the depth nearest to its own; rows that lack the target, that
    current, wind or stokes are left out. A predictor that is not used has coefficient 0 and mean 0, and without the
    current the target's mean is 0 too. One aggregation serves all depths; configurations choose among its rows.
    Columns: config, matched_depth, n, and re and im of c_current, c_wind, c_stokes, m_current, m_wind, m_stokes and m_y.
    """
    each = F.explode(F.array(*[F.struct(F.lit(float(d)).alias("matched_depth"), F.col(u).alias("x_u"), F.col(v).alias("x_v")) for d, (u, v) in currents.items()]))
    long = df.select(*target, *wind, *stokes, each.alias("m")).select("*", "m.*").drop("m")
    names = {"current": "use_current", "wind": "use_wind", "stokes": "use_stokes"}
    g = gram(long, target, {"current": ("x_u", "x_v"), "wind": wind, "stokes": stokes}, ["matched_depth"])
    used = nearest_depth(configs, list(currents)).join(F.broadcast(g), "matched_depth")
    off = {}
    for a, flag in names.items():
        for p in ("re", "im"):
            off[f"m_{a}_{p}"] = F.when(F.col(flag), F.col(f"m_{a}_{p}")).otherwise(0.0)
            off |= {f"g_{x}_{y}_{p}": F.when(F.col(flag) & (F.col(names[b]) if b in names else F.lit(True)), F.col(f"g_{x}_{y}_{p}")).otherwise(0.0) for b in ("y", *names) for x, y in ((a, b), (b, a))}
    off |= {f"m_y_{p}": F.when(F.col("use_current"), F.col(f"m_y_{p}")).otherwise(0.0) for p in ("re", "im")}
    # a row for each configuration; the coalesce keeps the solution's expressions apart from these
    fitted = least_squares(used.withColumns(off).coalesce(1), list(names))
    return fitted.select("config", "matched_depth", "n", *[f"{k}_{a}_{p}" for k in ("c", "m") for a in names for p in ("re", "im")], "m_y_re", "m_y_im")


def full_sweep(df: DataFrame, target: tuple[str, str], models: dict[str, tuple[str, str, str, str]]) -> DataFrame:
    """How each of ``models`` (predictor and second predictor, each as two columns) tells the target (H9).

    (model, n, r_raw, angle_raw, z_re, z_im, r_z, angle_z, c_x_*, c_w_*, r_reg, angle_reg, share_x, share_w): the complex
    correlation of the target with the predictor, with Z times it, and with the fit by both predictors, and the shares of
    the two in that fit by coefficient times mean size. All models' columns are stacked, and one aggregation gives their
    products, from which the correlations with fitted values follow without another pass.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(c).alias(n) for n, c in zip(("x_u", "x_v", "w_u", "w_v"), columns, strict=True)]) for m, columns in models.items()]))
    long = df.select(*target, each.alias("m")).select(*target, "m.*").dropna()
    sizes = long.groupBy("model").agg(F.avg(F.hypot("x_u", "x_v")).alias("s_x"), F.avg(F.hypot("w_u", "w_v")).alias("s_w"))
    g = gram(long, target, {"x": ("x_u", "x_v"), "w": ("w_u", "w_v")}, ["model"])
    g = least_squares(scale(correlation(g, "x"), "x").coalesce(1), ["x", "w"]).join(F.broadcast(sizes), "model").coalesce(1)
    a, b, z = _pair("c_x"), _pair("c_w"), _pair("z_x")
    yx, yw, xw = _pair("g_y_x"), _pair("g_y_w"), _pair("g_x_w")

    def told(cross: Z, power: Column) -> tuple[Column, Column]:
        known = (power > 0) & (F.col("g_y_y_re") > 0)
        return F.when(known, F.hypot(*cross) / F.sqrt(power * F.col("g_y_y_re"))), F.when(known, F.degrees(F.atan2(cross[1], cross[0])))

    by_z, ax, bw = product(z, yx), product(a, yx), product(b, yw)
    mixed = product(conj_product(a, b), xw)
    z_power = (z[0] * z[0] + z[1] * z[1]) * F.col("g_x_x_re")
    fit_power = (a[0] * a[0] + a[1] * a[1]) * F.col("g_x_x_re") + (b[0] * b[0] + b[1] * b[1]) * F.col("g_w_w_re") + 2 * mixed[0]
    r_z, r_reg = told(by_z, z_power), told((ax[0] + bw[0], ax[1] + bw[1]), fit_power)
    parts = F.hypot(*a) * F.col("s_x"), F.hypot(*b) * F.col("s_w")
    return g.select(
        "model", "n", F.col("r_x").alias("r_raw"), F.col("angle_x").alias("angle_raw"), F.col("z_x_re").alias("z_re"), F.col("z_x_im").alias("z_im"), r_z[0].alias("r_z"), r_z[1].alias("angle_z"),
        "c_x_re", "c_x_im", "c_w_re", "c_w_im", r_reg[0].alias("r_reg"), r_reg[1].alias("angle_reg"), F.try_divide(parts[0], parts[0] + parts[1]).alias("share_x"), F.try_divide(parts[1], parts[0] + parts[1]).alias("share_w"),
    )
