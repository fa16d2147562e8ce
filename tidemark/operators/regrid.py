"""Fields on uneven axes: cells found by search instead of arithmetic, in any number of dimensions and grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.search import position

#: Axis values, of all axes and grids together, up to which they are broadcast (8 bytes each).
MOST_VALUES = 200_000
#: Axis values in a coarse bucket, the unit of the two-level numbering beyond that.
COARSE = 1000


def _number(c: Column, kind: T.DataType) -> Column:
    """A coordinate as a double; times in seconds since 1970."""
    return F.unix_micros(c.cast("timestamp")) / 1e6 if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else c.cast("double")


def axis_values(field: DataFrame, axes: list[str], keys: list[str]) -> DataFrame:
    """(keys, axis, value) of all coordinates that occur, axes by their position; one pass that reads these columns only."""
    each = F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"_a{i}").alias("value")) for i in range(len(axes))])
    return field.select(*keys, F.inline(each)).where("value is not null").distinct()


def _by_search(points: DataFrame, nodes: DataFrame, values: DataFrame, n: int, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Points and nodes with the positions _i of their cell or node and the points' shares _f, the axes being broadcast."""
    arrays = values.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col("axis") == i, F.col("value")))).alias(f"_v{i}") for i in range(n)])
    steps = max(1, most.bit_length())
    joined = points.join(F.broadcast(arrays), keys, "left") if keys else points.join(F.broadcast(arrays), F.lit(True), "left")
    on_axis = nodes.join(F.broadcast(arrays), keys) if keys else nodes.join(F.broadcast(arrays))
    made, shares, own = {}, {}, {}
    for i in range(n):
        axis, x = F.col(f"_v{i}"), F.col(f"_a{i}")
        inside = (x >= F.get(axis, F.lit(0))) & (x <= F.get(axis, F.size(axis) - 1))
        at = F.greatest(F.least(position(x, axis, steps), F.size(axis) - 2), F.lit(0))
        made[f"_i{i}"] = F.when(inside, at)
        low, high = F.get(axis, F.col(f"_i{i}")), F.get(axis, F.col(f"_i{i}") + 1)
        shares[f"_f{i}"] = F.when(F.size(axis) > 1, (x - low) / (high - low)).when(x == low, 0.0)  # _o: an axis of one value, whose node is its own neighbour
        own |= {f"_i{i}": position(x, axis, steps), f"_o{i}": F.size(axis) == 1}
    drop = [f"_v{i}" for i in range(n)]
    return joined.withColumns(made).withColumns(shares).drop(*drop), on_axis.withColumns(own).drop(*drop)


def _numbered(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, after, i, size, least, width) of one axis: each value's successor and number, by coarse buckets and their sums."""
    span = values.groupBy(*keys).agg(F.min("value").alias("least"), F.max("value").alias("most"), F.count("*").alias("size"))
    span = span.withColumn("width", F.when(F.col("size") > 1, (F.col("most") - F.col("least")) / F.col("size")).otherwise(1.0)).drop("most")
    spread = values.join(span, keys) if keys else values.join(F.broadcast(span))
    spread = spread.withColumn("_coarse", F.floor((F.col("value") - F.col("least")) / F.col("width") / COARSE))
    within = Window.partitionBy(*keys, "_coarse").orderBy("value")
    spread = spread.withColumns({"_row": F.row_number().over(within), "_lead": F.lead("value").over(within)})
    across = Window.partitionBy(*keys).orderBy("_coarse")
    sums = spread.groupBy(*keys, "_coarse").agg(F.count("*").alias("_n"), F.min("value").alias("_first"))
    sums = sums.withColumns({"_before": F.sum("_n").over(across) - F.col("_n"), "_next": F.lead("_first").over(across)}).drop("_n", "_first")
    out = spread.join(sums, [*keys, "_coarse"])
    return out.select(*keys, "value", F.coalesce("_lead", "_next").alias("after"), (F.col("_before") + F.col("_row") - 1).cast("int").alias("i"), "size", "least", "width")


def _by_buckets(points: DataFrame, nodes: DataFrame, values: DataFrame, n: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """As _by_search(), by joins: each cell lies in the buckets that it touches, as many in all as twice the values."""
    for i in range(n):
        axis = _numbered(values.where(F.col("axis") == i).drop("axis"), keys)
        span = axis.groupBy(*keys).agg(F.first("least").alias("_least"), F.first("width").alias("_width"), F.first("size").alias("_size"))
        bucket = lambda x, least, width: F.floor((x - least) / width)
        ends = F.sequence(bucket(F.col("value"), F.col("least"), F.col("width")), bucket(F.coalesce("after", "value"), F.col("least"), F.col("width")))
        cells = axis.where("after is not null or size = 1").select(*keys, F.col("value").alias("_low"), F.col("after").alias("_high"), F.col("i").alias(f"_i{i}"), (F.col("i") >= F.col("size") - 2).alias("_last"), F.explode(ends).alias("_bucket"))
        x = F.col(f"_a{i}")
        placed = points.join(span, keys, "left") if keys else points.join(F.broadcast(span), F.lit(True), "left")
        placed = placed.withColumn("_at", bucket(x, F.col("_least"), F.col("_width"))).drop("_least", "_width", "_size")
        keyed = cells.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_low", "_high", f"_i{i}", "_last", "_bucket")
        inside = (F.col("_at") == F.col("_bucket")) & (x >= F.col("_low")) & ((x < F.col("_high")) | (F.col("_last") & (x == F.coalesce("_high", "_low"))))
        for k in keys:
            inside &= F.col(k) == F.col(f"_k_{k}")
        placed = placed.join(keyed, inside, "left").drop(*[f"_k_{k}" for k in keys])
        share = F.when(F.col("_high").isNull(), F.when(x == F.col("_low"), 0.0)).otherwise((x - F.col("_low")) / (F.col("_high") - F.col("_low")))
        points = placed.withColumn(f"_f{i}", share).drop("_low", "_high", "_last", "_at", "_bucket")
        named = axis.select(*keys, F.col("value").alias(f"_a{i}"), F.col("i").alias(f"_i{i}"), (F.col("size") == 1).alias(f"_o{i}"))
        nodes = nodes.join(named, [*keys, f"_a{i}"])
    return points, nodes


def at_points(points: DataFrame, field: DataFrame, axes: dict[str, str], keys: list[str] | None = None, values: list[str] | None = None, tag: str = "", most_values: int = MOST_VALUES) -> DataFrame:
    """``points`` with mapped_<value> of each of ``values``, linear along every axis.

    ``axes`` names each axis of the field and the points' column for it (times or numbers); the axes are those that
    occur in the field, even or not, for each combination of ``keys`` (products, say) its own. A point outside an
    axis, with a null coordinate, or beside a node that is absent or null gets null; one on the upper edge belongs
    to the last cell; an axis of one value tells only points on it. Repeated nodes must be equal.

    Axes of ``most_values`` values in all are broadcast and bisected; longer ones are numbered by buckets and joined. A node
    goes to the cells of which it is a corner, those with points only, and is gathered by one aggregation.
    """
    keys, values = keys or [], values or ["u", "v"]
    n = len(axes)
    kinds = {f.name: f.dataType for f in field.schema.fields}, {f.name: f.dataType for f in points.schema.fields}
    nodes = field.select(*keys, *[_number(F.col(a), kinds[0][a]).alias(f"_a{i}") for i, a in enumerate(axes)], *[F.col(v).cast("double").alias(f"_w{i}") for i, v in enumerate(values)])
    placed = points.withColumns({f"_a{i}": _number(F.col(p), kinds[1][p]) for i, p in enumerate(axes.values())})
    every = axis_values(nodes, list(axes), keys)
    sizes = every.groupBy(*keys, "axis").count().agg(F.sum("count"), F.max("count")).first()
    if (sizes[0] or 0) <= most_values:
        placed, nodes = _by_search(placed, nodes, every, n, keys, sizes[1] or 1)
    else:
        placed, nodes = _by_buckets(placed, nodes, every, n, keys)
    cell = [f"_i{i}" for i in range(n)]
    corner = F.col("_corner")
    bit = [F.shiftright(corner, i).bitwiseAND(1) for i in range(n)]
    corners = nodes.withColumn("_corner", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    corners = corners.select(*keys, *[F.when(F.col(f"_o{i}"), F.col(c)).otherwise(F.col(c) - b).alias(c) for i, (c, b) in enumerate(zip(cell, bit, strict=True))], F.struct("_corner", *[f"_w{i}" for i in range(len(values))]).alias("_node"))
    wanted = placed.select(*keys, *cell).dropna().distinct()
    gathered = corners.join(wanted, [*keys, *cell], "left_semi").groupBy(*keys, *cell).agg(F.sort_array(F.collect_set("_node")).alias("_nodes"))
    joined = placed.join(gathered, [*keys, *cell], "left")

    def weight(c: Column, i: int) -> Column:
        return F.when(F.shiftright(c["_corner"], i).bitwiseAND(1) == 1, F.col(f"_f{i}")).otherwise(1 - F.col(f"_f{i}"))

    def mixed(w: str) -> Column:
        total = F.aggregate("_nodes", F.lit(0.0), lambda acc, c: acc + reduce(lambda a, b: a * b, (weight(c, i) for i in range(n))) * c[w])
        return F.when(F.size("_nodes") == 1 << n, total)

    return joined.select(*points.columns, *[mixed(f"_w{i}").alias(f"mapped_{v}{tag}") for i, v in enumerate(values)])
