"""Gridded fields as long tables (product, time, depth, lat, lon, u, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import regrid
from tidemark.operators.quantiles import select


def harmonise(field: DataFrame, digits: int = 4) -> DataFrame:
    """Coordinates rounded so that keys join (B1)."""
    return field.withColumns({c: F.round(c, digits) for c in ("lat", "lon", "depth") if c in field.columns})


def append(old: DataFrame, new: DataFrame, keys: tuple = ("time", "depth", "lat", "lon")) -> DataFrame:
    """Old and new rows; of a cell in both, the old one (B2)."""
    both = old.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)))
    others = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.min_by(F.struct(*others), "_rank").alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in others])


def fill_gaps(field: DataFrame, axis: str, others: list[str], values: tuple = ("u", "v")) -> DataFrame:
    """Nulls between two known cells of an axis filled linearly; none beyond the last."""
    w = Window.partitionBy(*others).orderBy(axis)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = {}
    for v in values:
        known = F.when(F.col(v).isNotNull(), F.struct(F.col(axis).alias("x"), F.col(v).alias("y")))
        p, n = F.last(known, ignorenulls=True).over(before), F.first(known, ignorenulls=True).over(after)
        out[v] = F.when(F.col(v).isNotNull(), F.col(v)).otherwise(p["y"] + (n["y"] - p["y"]) * F.try_divide(F.col(axis) - p["x"], n["x"] - p["x"]))
    return field.withColumns(out)


def add_depths(old: DataFrame, new: DataFrame) -> DataFrame:
    """New depth levels within the old time span, then gaps filled along lat, then along lon."""
    span = old.agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    inside = new.join(F.broadcast(span), F.col("time").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    both = old.unionByName(inside)
    return fill_gaps(fill_gaps(both, "lat", ["time", "depth", "lon"]), "lon", ["time", "depth", "lat"])


def merge_products(winds: DataFrame, waves: DataFrame) -> DataFrame:
    """Winds with the wave drift of the same cell."""
    return winds.join(waves.withColumnsRenamed({"u": "ust", "v": "vst"}).select("time", "lat", "lon", "ust", "vst"), ["time", "lat", "lon"])


def daily_climatology(months: DataFrame, year: int) -> DataFrame:
    """(day, lat, lon, u, v): monthly means stamped on the 15th, linear in time over a year."""
    stamp = F.make_date(F.lit(year), F.col("month"), F.lit(15))
    slices = months.select(stamp.alias("day"), "lat", "lon", "u", "v")
    before = months.where("month = 12").select(F.make_date(F.lit(year - 1), F.lit(12), F.lit(15)).alias("day"), "lat", "lon", "u", "v")
    after = months.where("month = 1").select(F.make_date(F.lit(year + 1), F.lit(1), F.lit(15)).alias("day"), "lat", "lon", "u", "v")
    w = Window.partitionBy("lat", "lon").orderBy("day")
    seg = slices.union(before).union(after).withColumns({"_d1": F.lead("day").over(w), "_u1": F.lead("u").over(w), "_v1": F.lead("v").over(w)}).where("_d1 is not null")
    days = seg.withColumn("_d", F.explode(F.sequence("day", F.date_sub("_d1", 1)))).where(F.year("_d") == year)
    share = F.datediff("_d", "day") / F.datediff("_d1", "day")
    return days.select(F.col("_d").alias("day"), "lat", "lon", (F.col("u") + (F.col("_u1") - F.col("u")) * share).alias("u"), (F.col("v") + (F.col("_v1") - F.col("v")) * share).alias("v"))


def mean_by_depth(field: DataFrame, start: str, end: str) -> DataFrame:
    """Mean velocity over a closed time slice, by depth."""
    inside = field.where(F.col("time").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return inside.groupBy("depth").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))


def mean_with_drift(current: DataFrame, drift: DataFrame, depth: float) -> DataFrame:
    """(depth, n, u, v): mean of current plus drift at the depth nearest to ``depth``, of two as near the upper.

    The drift (time, lat, lon, u, v) has axes of its own and is brought to the current's nodes; nodes outside it, or
    where either is missing, are left out.
    """
    nearest = current.agg(F.min(F.struct(F.abs(F.col("depth") - depth).alias("d"), F.col("depth").alias("at"))).alias("_best")).select(F.col("_best.at").alias("depth"))
    nodes = current.join(F.broadcast(nearest), "depth").select("time", "depth", "lat", "lon", "u", "v")
    both = regrid.at_points(nodes, drift, {"time": "time", "lat": "lat", "lon": "lon"}).dropna(subset=["u", "v", "mapped_u", "mapped_v"])
    return both.groupBy("depth").agg(F.count("*").alias("n"), F.avg(F.col("u") + F.col("mapped_u")).alias("u"), F.avg(F.col("v") + F.col("mapped_v")).alias("v"))


def cell_table(field: DataFrame, keys: list[str], values: list[str] | None = None) -> DataFrame:
    """Cells (keys, t0, lat0, lon0, t1, lat1, lon1, c[8] of the values): each lower corner with its upper neighbours.

    Three passes pair each axis with its next value; a corner that is missing leaves the cell out.
    """
    corner = F.array(F.struct(*(values or ["u", "v"])))
    out = field.select(*keys, F.col("time").alias("t0"), F.col("lat").alias("lat0"), F.col("lon").alias("lon0"), corner.alias("c"))
    for axis, name in (("lon0", "lon1"), ("lat0", "lat1"), ("t0", "t1")):
        rest = [*keys, *[a for a in ("t0", "lat0", "lon0") if a != axis], *[n for n in ("lon1", "lat1") if n in out.columns]]
        w = Window.partitionBy(*rest).orderBy(axis)
        out = out.withColumns({name: F.lead(axis).over(w), "_c": F.lead("c").over(w)}).where(F.col(name).isNotNull())
        out = out.withColumn("c", F.concat("c", "_c")).drop("_c")
    return out


def at_points(points: DataFrame, field: DataFrame, grid: dict[str, tuple[float, float, int]], keys: list[str] | None = None, tag: str = "", ts: str = "ts", values: list[str] | None = None) -> DataFrame:
    """``points`` with mapped_u and mapped_v (or the ``values`` named), linear in time, lat and lon; null outside or beside a missing cell.

    ``grid`` gives (start, step, number) of regular axes: lat and lon in degrees, time in seconds since 1970. A
    point finds its cell by arithmetic, so one equi-join does it; a point on the upper edge belongs to the last cell.
    """
    keys, values = keys or [], values or ["u", "v"]
    where = {"time": F.unix_micros(F.col(ts).cast("timestamp")) / 1e6, "lat": F.col("lat"), "lon": F.col("lon")}
    short = {"time": "t", "lat": "y", "lon": "x"}
    p = points
    for axis, (start, step, n) in grid.items():
        at = (where[axis] - start) / step
        i = F.when((at >= 0) & (at <= n - 1), F.least(F.floor(at), F.lit(n - 2)).cast("int"))
        p = p.withColumns({f"_{short[axis]}": i, f"_f{short[axis]}": at - i})
    cells = cell_table(field, keys, values)
    for axis, lower, s in (("time", F.unix_micros(F.col("t0").cast("timestamp")) / 1e6, "t"), ("lat", F.col("lat0"), "y"), ("lon", F.col("lon0"), "x")):
        start, step, _ = grid[axis]
        cells = cells.withColumn(f"_{s}", F.round((lower - start) / step).cast("int"))
    joined = p.join(cells.select(*keys, "_t", "_y", "_x", "c"), [*keys, "_t", "_y", "_x"], "left")

    def mix(part: str) -> Column:
        total = None
        for t in (0, 1):
            for y in (0, 1):
                for x in (0, 1):
                    weight = (F.col("_ft") if t else 1 - F.col("_ft")) * (F.col("_fy") if y else 1 - F.col("_fy")) * (F.col("_fx") if x else 1 - F.col("_fx"))
                    term = weight * F.col("c")[4 * t + 2 * y + x][part]
                    total = term if total is None else total + term
        return total

    return joined.select(*points.columns, *[mix(x).alias(f"mapped_{x}{tag}") for x in values])


def products_at_points(points: DataFrame, field: DataFrame, products: list[str], grid: dict[str, tuple[float, float, int]], ts: str = "ts") -> DataFrame:
    """``points`` with mapped_<product>_u and _v of each product of rows (product, time, lat, lon, u, v).

    The products, which share a grid, are pivoted to columns first, so the points are joined once however many
    there are; a product that lacks a corner is null there and leaves the others alone.
    """
    wide = field.groupBy("time", "lat", "lon").pivot("product", products).agg(F.first("u").alias("u"), F.first("v").alias("v"))
    return at_points(points, wide, grid, ts=ts, values=[f"{p}_{c}" for p in products for c in ("u", "v")])


def corrected(field: DataFrame, means: dict[str, complex], m: complex = 1, n: complex = 0, s: complex = 0, bias: bool = True, static: bool = False) -> DataFrame:
    """Corrected current of rows (u, v, uw, vw, ust, vst).

    With bias: m (U - mean) + n (W - mean) + s (S - mean) + mean of U. Without: U + s S + n (W - mean). The
    static form adds the waves first: m (U + s S) + n W. Complex numbers are pairs of columns.
    """

    def times(c: complex, re: Column, im: Column) -> tuple[Column, Column]:
        c = complex(c)
        return c.real * re - c.imag * im, c.real * im + c.imag * re

    u, w, st = ((F.col("u"), F.col("v")), (F.col("uw"), F.col("vw")), (F.col("ust"), F.col("vst")))

    def less(z: tuple[Column, Column], name: str) -> tuple[Column, Column]:
        c = complex(means.get(name, 0))
        return z[0] - c.real, z[1] - c.imag

    if static:
        wave = times(s, *st)
        parts = [times(m, u[0] + wave[0], u[1] + wave[1]), times(n, *w)]
    elif bias:
        back = complex(means.get("u", 0))
        parts = [times(m, *less(u, "u")), times(n, *less(w, "w")), times(s, *less(st, "s")), (F.lit(back.real), F.lit(back.imag))]
    else:
        parts = [u, times(s, *st), times(n, *less(w, "w"))]
    return field.withColumns({"cu": sum((p[0] for p in parts[1:]), parts[0][0]), "cv": sum((p[1] for p in parts[1:]), parts[0][1])})


def daily_snapshots(field: DataFrame, days: DataFrame) -> DataFrame:
    """Field rows at the time nearest to each start (B9); of two as near, the earlier."""
    axis = field.select("time").distinct().agg(F.sort_array(F.collect_list("time")).alias("_axis"))
    near = F.array_min(F.transform("_axis", lambda t: F.struct(F.abs(F.unix_micros(t) - F.unix_micros("start")).alias("d"), t.alias("t"))))["t"]
    return days.join(F.broadcast(axis)).select("start", near.alias("time")).join(field, "time")


def zonal_mean(field: DataFrame) -> DataFrame:
    """(time, lat, u): mean over longitudes."""
    return field.groupBy("time", "lat").agg(F.avg("u").alias("u"))


def zonal_scale(field: DataFrame, q: float = 0.98, few: int | None = None) -> DataFrame:
    """The q-quantile of the zonal means' size, to scale them by (B13); with ``few`` by selection (quantiles.select)."""
    size = zonal_mean(field).select(F.abs("u").alias("u"))
    return select(size, [], "u", [q], few).select(F.col("quantiles")[0].alias("scale")) if few else size.agg(F.percentile("u", F.lit(q)).alias("scale"))


def quarterly_profile(field: DataFrame) -> DataFrame:
    """(year, quarter, lat, u): mean over times of the zonal means."""
    return zonal_mean(field).groupBy(F.year("time").alias("year"), F.quarter("time").alias("quarter"), "lat").agg(F.avg("u").alias("u"))


def zero_crossing(field: DataFrame) -> DataFrame:
    """(time, lat): the southernmost latitude where the zonal mean turns from negative; null where none."""
    w = Window.partitionBy("time").orderBy("lat")
    z = zonal_mean(field).withColumns({"_u1": F.lead("u").over(w), "_lat1": F.lead("lat").over(w)})
    cross = (F.signum("_u1") - F.signum("u") > 0) & (F.col("u") < 0)
    at = F.col("lat") + (F.col("_lat1") - F.col("lat")) * F.try_divide(-F.col("u"), F.col("_u1") - F.col("u"))
    return z.groupBy("time").agg(F.min_by(F.when(cross, at), F.when(cross, F.col("lat"))).alias("lat"))


def spatial_variance(field: DataFrame) -> DataFrame:
    """(day, variance): population variance of u and of v over all cells of a day, added."""
    return field.groupBy(F.to_date("time").alias("day")).agg((F.var_pop("u") + F.var_pop("v")).alias("variance"))


def variance_at_starts(field: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` (day, ...) with the spatial variance of the field on their start day; null without one."""
    return runs.join(spatial_variance(field), "day", "left")
