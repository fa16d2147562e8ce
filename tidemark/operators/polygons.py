"""Fixes in many polygons: polygons go by blocks, fixes to the blocks whose polygons reach their cell, and pairs are not shuffled.

A polygon is a row (poly_id, ring) with its vertices array<struct<lon, lat>>, closed by itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.geo import segment_meets_box
from tidemark.operators.tracks import track
from tidemark.sources.scratch import written

#: Cells are 2^-LEVEL degrees wide, so their edges are exact doubles.
LEVEL = 3
#: Least width of a block in degrees; that of a polygon is twice as wide as long as it is less than the polygon.
BLOCK = 2.0
#: About so many fixes and sides of rings meet in one group; a row has so many sides at most, a batch of results so many pairs.
FIXES, SIDES, PIECE, PAIRS = 250_000, 2_000_000, 64, 500_000
#: Far more than rounding moves a crossing, in degrees.
MARGIN = 1e-9


def edges(polygons: DataFrame) -> DataFrame:
    """(poly_id, x0, y0, x1, y1) of every side."""
    following = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    side = F.inline(F.zip_with("ring", following, lambda a, b: F.struct(a["lon"].alias("x0"), a["lat"].alias("y0"), b["lon"].alias("x1"), b["lat"].alias("y1"))))
    return polygons.where(F.size("ring") > 2).select("poly_id", side)


def _index(x: Column, level: int) -> Column:
    return F.floor(x * (1 << level)).cast("int")


def cover(polygons: DataFrame, level: int = LEVEL) -> DataFrame:
    """(poly_id, ix, iy, boundary): the cells that a side touches, and those wholly inside.

    A side gives the cells of its own extent that it meets; so many short sides cost little. In each row of cells
    the others lie inside if an odd number of sides passes to their right.
    """
    size = 1.0 / (1 << level)
    sides = edges(polygons)
    # a side on the line between two cells touches both
    low = lambda a, b: F.ceil(F.least(a, b) / size).cast("int") - 1
    spread = sides.withColumn("iy", F.explode(F.sequence(low("y0", "y1"), _index(F.greatest("y0", "y1"), level)))).withColumn("ix", F.explode(F.sequence(low("x0", "x1"), _index(F.greatest("x0", "x1"), level))))
    x, y = F.col("ix") * size, F.col("iy") * size
    met = segment_meets_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), (x, x + size, y, y + size))
    boundary = spread.where(met).select("poly_id", "ix", "iy").distinct()
    extent = sides.groupBy("poly_id").agg(F.min(_index(F.least("x0", "x1"), level)).alias("a"), F.max(_index(F.greatest("x0", "x1"), level)).alias("b"))
    middle = (F.col("iy") + 0.5) * size
    crossed = sides.withColumn("iy", F.explode(F.sequence(_index(F.least("y0", "y1"), level), _index(F.greatest("y0", "y1"), level)))).where((F.col("y0") > middle) != (F.col("y1") > middle))
    rows = crossed.groupBy("poly_id", "iy").agg(F.collect_list((F.col("x1") - F.col("x0")) * (middle - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")).alias("at"))
    cells = rows.join(extent, "poly_id").withColumn("ix", F.explode(F.sequence("a", "b")))
    odd = F.aggregate("at", F.lit(0), lambda n, c: n + F.when(c > (F.col("ix") + 0.5) * size, 1).otherwise(0)) % 2 == 1
    inside = cells.where(odd).select("poly_id", "ix", "iy").join(boundary, ["poly_id", "ix", "iy"], "left_anti")
    return boundary.withColumn("boundary", F.lit(True)).unionByName(inside.withColumn("boundary", F.lit(False)))


def _met_in_groups(fixes: DataFrame, polygons: DataFrame, by: list[str], level: int) -> DataFrame:
    """``fixes`` (lon, lat known) and rings in one table, each row with the _key of a group; a pair that may meet does so in one group.

    A polygon belongs to the block with its least corner, a fix to those with a polygon whose extent meets its cell; at most four
    of one width. A block of many fixes is parted by ``by``, whose rings go to all parts, one of many sides by poly_id.
    Of a ring there are pieces _x, _y of PIECE sides; fixes have nulls there.
    """
    closed = F.concat("ring", F.slice("ring", 1, 1))
    rings = polygons.where(F.size("ring") > 2).select("poly_id", F.transform(closed, lambda p: p["lon"]).alias("_x"), F.transform(closed, lambda p: p["lat"]).alias("_y"))
    wide = F.greatest(*[F.array_max(c) - F.array_min(c) for c in ("_x", "_y")])
    rings = rings.withColumn("_k", F.greatest(F.lit(0), F.ceil(F.log2(wide / BLOCK))).cast("int"))
    rings = rings.withColumns({f"_b{c}": F.floor(F.array_min(f"_{c}") / (BLOCK * F.pow(F.lit(2.0), "_k"))) for c in ("x", "y")})
    block = ["_k", "_bx", "_by"]
    rings = written(rings, "rings")
    extent = [F.explode(F.sequence(_index(F.array_min(c) - MARGIN, level), _index(F.array_max(c) + MARGIN, level))).alias(i) for c, i in (("_x", "ix"), ("_y", "iy"))]
    cells = written(rings.select("_x", *block, extent[1]).select(*block, "iy", extent[0]).distinct(), "cells")
    at = {"ix": _index(F.col("lon"), level), "iy": _index(F.col("lat"), level)}
    seen = fixes.groupBy(at["ix"].alias("ix"), at["iy"].alias("iy")).agg(F.count("*").alias("_n"))
    blocks = rings.groupBy(*block).agg(F.sum(F.size("_x")).alias("_m")).join(cells.join(seen, ["ix", "iy"]).groupBy(*block).agg(F.sum("_n").alias("_n")), block)
    parts = [F.least(F.ceil(F.col(c) / most), F.lit(1 << 15)).cast("int").alias(p) for c, most, p in (("_n", FIXES, "_f"), ("_m", SIDES, "_p"))]
    # as few rows as blocks of the sphere; numbers of one run are read by both sides
    blocks = written(blocks.select(*block, *parts, F.row_number().over(Window.orderBy(*block)).alias("_block")), "blocks")
    key = lambda f, p: (F.col("_block").cast("long") * (1 << 32) + f * (1 << 16) + p).alias("_key")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("_to")
    reached = written(cells.join(blocks, block).select("ix", "iy", "_block", "_f", "_p"), "reached")
    sent = fixes.withColumns(at).join(reached, ["ix", "iy"]).select(*fixes.columns, "_block", F.pmod(F.xxhash64(*by), "_f").alias("_own"), each("_p"))
    dealt = rings.join(blocks, block).select("poly_id", "_x", "_y", "_block", F.pmod(F.xxhash64("poly_id"), "_p").alias("_own"), each("_f"))
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.size("_x") - 2) / PIECE).cast("int"))).alias("_i")
    dealt = dealt.select("*", piece).select(key(F.col("_to"), F.col("_own")), "poly_id", *[F.slice(c, F.col("_i") * PIECE + 1, PIECE + 1).alias(c) for c in ("_x", "_y")])
    return dealt.unionByName(sent.select(*fixes.columns, key(F.col("_own"), F.col("_to"))), allowMissingColumns=True)


class _Rings:
    """Polygons of a group with their sides, those that never cross a parallel left out."""

    def __init__(self, rows: pa.Table) -> None:
        coded = rows["poly_id"].combine_chunks().dictionary_encode()
        self.names = coded.dictionary
        x, y = (rows[c].combine_chunks() for c in ("_x", "_y"))
        ends = np.cumsum(np.diff(x.offsets.to_numpy()))
        x, y = x.flatten().to_numpy(zero_copy_only=False), y.flatten().to_numpy(zero_copy_only=False)
        of = np.repeat(coded.indices.to_numpy(), np.diff(ends, prepend=0))
        side = np.ones(len(x), bool)
        side[ends - 1] = False
        first = np.flatnonzero(side)
        first = first[y[first] != y[first + 1]]
        first = first[np.argsort(of[first], kind="stable")]
        bounds = np.searchsorted(of[first], np.arange(len(self.names) + 1))
        some = np.flatnonzero(np.diff(bounds))
        x0, y0, x1, y1 = x[first], y[first], x[first + 1], y[first + 1]
        self.low, self.high = np.minimum(y0, y1), np.maximum(y0, y1)
        west, east = (np.minimum.reduceat(np.minimum(x0, x1), bounds[some]), np.maximum.reduceat(np.maximum(x0, x1), bounds[some])) if len(some) else ((), ())
        self.sides = list(zip(x0.tolist(), y0.tolist(), (x1 - x0).tolist(), (y1 - y0).tolist(), strict=True))
        self.each = list(zip(some.tolist(), bounds[some].tolist(), bounds[some + 1].tolist(), west, east, strict=True))

    def hits(self, lon: np.ndarray, lat: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(polygon, positions within it) by the even-odd rule, as geo.in_polygon.

        Points lie by strips of longitude, in each by latitude: so a side meets slices, in which it turns what lies to its left.
        """
        strips = int(np.clip(len(lon) // 2000, 1, 64))
        origin = lon.min()
        width = max((lon.max() - origin) / strips, 1e-9)
        strip = np.minimum(((lon - origin) / width).astype(np.int64), strips - 1)
        order = np.lexsort((lat, strip))
        starts = np.searchsorted(strip[order], np.arange(strips + 1)).tolist()
        lon, lat = lon[order], lat[order]
        parts = [lat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        for name, s, e, west, east in self.each:
            found = []
            for t in range(max(0, int((west - MARGIN - origin) // width)), min(strips - 1, int((east + MARGIN - origin) // width)) + 1):
                a, b = parts[t].searchsorted(self.low[s:e]).tolist(), parts[t].searchsorted(self.high[s:e]).tolist()
                first, last = min(a), max(b)
                if first == last:
                    continue
                start = starts[t]
                inside = np.zeros(last - first, bool)
                for (x0, y0, dx, dy), i, j in zip(self.sides[s:e], a, b, strict=True):
                    if i < j:
                        at = lat[start + i : start + j] - y0
                        at *= dx
                        at /= dy
                        at += x0
                        inside[i - first : j - first] ^= lon[start + i : start + j] < at
                at = np.flatnonzero(inside)
                if len(at):
                    found.append(order[at + (start + first)])
            if found:
                yield name, found


def _by_group(kept: list[str], run: Callable[[pa.Table], Callable] | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Kernel over the sorted rows of _met_in_groups(), rings first: holds a group's rings and FIXES fixes at a time, or whole tracks.

    Columns ``kept`` of the fixes and poly_id; ``run`` makes, of the fixes that it is given, a function of positions within one polygon
    that gives the positions to keep and further columns.
    """

    def results(rings: _Rings, fixes: pa.Table) -> Iterator[pa.RecordBatch]:
        fixes = fixes.combine_chunks()
        columns = {c: fixes[c].combine_chunks() for c in kept}
        chosen = run(fixes) if run else None
        names, rows, more, n = [], [], [], 0

        def batch() -> pa.RecordBatch:
            at = np.concatenate(rows)
            made = {c: v.take(pa.array(at)) for c, v in columns.items()} | {"poly_id": rings.names.take(pa.array(np.repeat(names, list(map(len, rows)))))}
            return pa.RecordBatch.from_pydict(made | {c: pa.concat_arrays([m[c] for m in more]) for c in more[0]})

        for name, found in rings.hits(fixes["lon"].to_numpy(), fixes["lat"].to_numpy()):
            for at, extra in [chosen(np.concatenate(found))] if chosen else [(x, {}) for x in found]:
                if len(at):
                    names.append(name), rows.append(at), more.append(extra)
                    n += len(at)
            if n >= PAIRS:
                yield batch()
                names, rows, more, n = [], [], [], 0
        if n:
            yield batch()

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rings, held, n, most = None, [], [], 0, FIXES * 1.25
        for batch in batches:
            keys = batch["_key"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)] if len(keys) else []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if keys[a] != key:
                    if held and rings:
                        yield from results(rings if isinstance(rings, _Rings) else _Rings(pa.Table.from_batches(rings)), pa.Table.from_batches(held))
                    key, rings, held, n, most = keys[a], [], [], 0, FIXES * 1.25
                part = batch.slice(a, b - a)
                split = len(part) - part["_x"].null_count
                if split:
                    rings.append(part.slice(0, split).select(["poly_id", "_x", "_y"]))
                if split < len(part):
                    held.append(part.slice(split))
                    n += len(part) - split
                if n >= most and rings:
                    rings = rings if isinstance(rings, _Rings) else _Rings(pa.Table.from_batches(rings))
                    fixes = pa.Table.from_batches(held)
                    whole = n
                    if run:  # up to where the last track begins
                        track_ = fixes["buoy_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
                        whole = int(np.flatnonzero(track_ != track_[-1])[-1]) + 1 if (track_ != track_[-1]).any() else 0
                    if whole:
                        yield from results(rings, fixes.slice(0, whole))
                        held, n, most = fixes.slice(whole).to_batches(), n - whole, FIXES * 1.25
                    else:
                        most = 2 * n
        if held and rings:
            yield from results(rings if isinstance(rings, _Rings) else _Rings(pa.Table.from_batches(rings)), pa.Table.from_batches(held))

    return over


def _known(fixes: DataFrame) -> DataFrame:
    return fixes.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~F.isnan("lon") & ~F.isnan("lat"))


def in_polygons(fixes: DataFrame, polygons: DataFrame, level: int = LEVEL, columns: list[str] | None = None) -> DataFrame:
    """Fixes, or their ``columns``, with the poly_id of each polygon they lie in: a row for each pair.

    A fix in no polygon has no row, nor has one of a null position; a ring of fewer than three vertices holds nothing. Pairs leave
    the tasks that find them as they are found.
    """
    kept = columns or fixes.columns
    needed = _known(fixes.select(*dict.fromkeys([*kept, "lon", "lat"])))
    met = _met_in_groups(needed, polygons, [f.name for f in needed.schema if isinstance(f.dataType, T.AtomicType)], level)
    schema = T.StructType([*[fixes.schema[c] for c in kept], polygons.schema["poly_id"]])
    return met.repartition("_key").sortWithinPartitions("_key", F.col("_x").isNull()).mapInArrow(_by_group(kept), schema)


def runs_in_polygons(fixes: DataFrame, polygons: DataFrame, least: int = 2, level: int = LEVEL, columns: list[str] | None = None) -> DataFrame:
    """Fixes, or their ``columns``, in each polygon with run, the number of the fix with which their stay began, and its length; shorter runs go.

    Fixes of a track that follow one another within a polygon are one run. All fixes of a track that a polygon may hold meet it in one
    group, so runs are told where the pairs are found.
    """
    kept = columns or fixes.columns
    numbered = fixes.withColumn("_n", F.row_number().over(track()))
    needed = _known(numbered.select(*dict.fromkeys([*kept, "lon", "lat", "buoy_id", "fix_id"]), "_n"))
    met = _met_in_groups(needed, polygons, ["buoy_id"], level)

    def run(rows: pa.Table) -> Callable:
        buoy, n = rows["buoy_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), rows["_n"].to_numpy()
        # one more than before it where a fix follows the last, two more elsewhere
        place = np.cumsum(np.where((np.diff(buoy, prepend=-1) == 0) & (np.diff(n, prepend=-1) == 1), 1, 2))
        at = np.zeros(int(place[-1]) + 1, np.int64)
        at[place] = np.arange(len(place))
        fix = rows["fix_id"].combine_chunks()

        def chosen(found: np.ndarray) -> list:
            there = np.sort(place[found])
            starts = np.concatenate([[0], np.flatnonzero(np.diff(there) != 1) + 1])
            long = np.diff(starts, append=len(there))
            stays = np.repeat(long >= least, long)
            begun, length = np.repeat(at[there[starts]], long)[stays], np.repeat(long, long)[stays]
            return at[there][stays], {"run": fix.take(pa.array(begun)), "run_len": pa.array(length)}

        return chosen

    schema = T.StructType([*[fixes.schema[c] for c in kept], polygons.schema["poly_id"], T.StructField("run", fixes.schema["fix_id"].dataType), T.StructField("run_len", T.LongType())])
    return met.repartition("_key").sortWithinPartitions("_key", F.col("_x").isNull(), "buoy_id", "_n").mapInArrow(_by_group(kept, run), schema)
