"""Bootstrap from a table of draws (resample, draw, idx): repeatable, and cheap by sums for each block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.scratch import written


#: Modulus of the draws, a prime.
PRIME = 2147483647
#: Where the distribution of a Poisson number of mean 1 passes to 1, 2, ..., as parts of PRIME.
POISSON = [int(PRIME * math.exp(-1) * sum(1 / math.factorial(j) for j in range(i + 1))) for i in range(9)]
#: Cells whose sums a task keeps at a time, and rows whose numbers of draws it makes at once.
MOST_CELLS, ROWS = 1000, 1024


def drawn_index(resample: Column, draw: Column, n: int | Column, seed: int) -> Column:
    """A number 0..n-1 for each draw: a cubic in (resample, draw) modulo a prime, which SQL can repeat.

    A linear form would give each n draws every number once, so no resample would differ from another.
    """
    k = ((resample * 7919 + draw * 104729 + seed) * 48271) % PRIME
    return ((k * k) % PRIME * k + k) % PRIME % n


def draws(spark: SparkSession, resamples: int, n: int, size: int | None = None, seed: int = 1) -> DataFrame:
    """(resample, draw, idx): draws with replacement from 0..n-1 by whole-number arithmetic that any SQL engine can repeat."""
    size = n if size is None else size
    r = spark.range(resamples).select(F.col("id").alias("resample"))
    d = spark.range(size).select(F.col("id").alias("draw"))
    return r.join(F.broadcast(d)).withColumn("idx", drawn_index(F.col("resample"), F.col("draw"), n, seed))


def band(means: DataFrame, keys: list[str], value: str = "mean") -> DataFrame:
    """Mean and 2.5 / 97.5 % points over resamples."""
    p = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(F.avg(value).alias("mean"), p.alias("_p")).select(*keys, "mean", F.col("_p")[0].alias("low"), F.col("_p")[1].alias("high"))


def over_blocks(rows: DataFrame, block: str, keys: list[str], value: str, draw_table: DataFrame) -> DataFrame:
    """Band of the mean of ``value`` by keys when blocks are drawn with replacement.

    Rows are reduced to a sum and a count for each block and key, and draws to how often each block comes; so the cost
    is resamples times blocks times keys, whatever the number of rows.
    """
    sums = rows.groupBy(F.col(block).cast("long").alias("idx"), *keys).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    times = draw_table.groupBy("resample", "idx").agg(F.count("*").alias("c"))
    joined = sums.join(times, "idx").groupBy("resample", *keys)
    means = joined.agg(F.try_divide(F.sum(F.col("c") * F.col("s")), F.sum(F.col("c") * F.col("n"))).alias("mean"))
    return band(means, keys)


def numbered_blocks(rows: DataFrame, start_us: str, days: float = 100) -> tuple[DataFrame, int]:
    """(``rows`` with block, number of blocks), for draws(): blocks of ``days`` days since the first start, those that hold rows numbered from 0 (I8).

    Rows of a null start have no block and are drawn by no resample. There are as many blocks as the rows' span has
    periods, so they are numbered in one task and broadcast. ``rows`` is read for its first start, for its blocks and for
    the result, so it is written to the shared folder once.
    """
    rows = written(rows, "rows")
    length = int(days * 8.64e10)
    period = F.floor((F.col(start_us) - F.col("_origin")) / length)
    placed = rows.join(F.broadcast(rows.agg(F.min(start_us).alias("_origin")))).withColumn("_period", period).drop("_origin")
    blocks = placed.where("_period is not null").select("_period").distinct().withColumn("block", (F.row_number().over(Window.orderBy("_period")) - 1).cast("long"))
    return placed.join(F.broadcast(blocks), "_period", "left").select(*rows.columns, "block"), max(blocks.count(), 1)


def coherence_band(spectra: DataFrame, block: str, draw_table: DataFrame) -> DataFrame:
    """Band of the coherence when blocks of chunks are drawn with replacement (I14); null for k = 0, as in coherence()."""
    parts = ("auto_a", "auto_b", "cross_re", "cross_im")
    sums = spectra.groupBy(F.col(block).cast("long").alias("idx"), "k").agg(*[F.sum(p).alias(p) for p in parts])
    times = draw_table.groupBy("resample", "idx").agg(F.count("*").alias("c"))
    drawn = sums.join(times, "idx").groupBy("resample", "k").agg(*[F.sum(F.col("c") * F.col(p)).alias(p) for p in parts])
    top = F.col("cross_re") * F.col("cross_re") + F.col("cross_im") * F.col("cross_im")
    value = F.when(F.col("k") > 0, F.try_divide(top, F.col("auto_a") * F.col("auto_b")))
    return band(drawn.select("resample", "k", value.alias("mean")), ["k"])


def _times_drawn(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """How often each resample draws the row of each key: Poisson numbers of mean 1, by the cubic of drawn_index()."""
    k = (np.arange(resamples)[None, :] * 7919 + (keys % PRIME)[:, None] * 104729 + seed) % PRIME * 48271 % PRIME
    return np.searchsorted(POISSON, ((k * k) % PRIME * k + k) % PRIME, side="right")


def cell_error(rows: DataFrame, cells: list[str], value: str, key: str, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """(cells, mean, error): mean in each cell and the 95 % point of its bootstrap means above it.

    A resample takes each row a Poisson number of times that follows from its ``key``, a whole number of 0 or more;
    rows of a null value or key are left out. Each task adds up the sums and counts of all resamples of the cells
    that it meets, in vectors, and gives one row for each of them (again after MOST_CELLS); no row is copied, and
    what is shuffled grows with cells and tasks. A cell of which a resample draws nothing has no mean in it.
    """
    known = rows.select(F.struct(*cells).alias("cell"), F.col(value).cast("double").alias("x"), F.col(key).cast("long").alias("key")).dropna(subset=["x", "key"])
    schema = T.StructType([known.schema["cell"], *T.StructType.fromDDL("s array<double>, n array<bigint>, total double, rows bigint").fields])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        kind = None

        def given() -> pa.RecordBatch:
            made = [[dict(zip(cells, c, strict=True)) for c in held], *zip(*held.values(), strict=True)]
            kinds = (kind, pa.list_(pa.float64()), pa.list_(pa.int64()), pa.float64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(made, kinds, strict=True)], names=schema.names)

        for batch in batches:
            kind = batch.column("cell").type
            x, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "key"))
            own = [tuple(c.values()) for c in batch.column("cell").to_pylist()]
            number = {c: i for i, c in enumerate(dict.fromkeys(own))}
            place = np.array([number[c] for c in own], dtype=np.int64)
            for c, i in number.items():
                of = held.setdefault(c, [np.zeros(resamples), np.zeros(resamples, dtype=np.int64), 0.0, 0])
                at = np.flatnonzero(place == i)
                for part in np.split(at, range(ROWS, len(at), ROWS)):
                    times = _times_drawn(keys[part], resamples, seed)
                    of[0] += x[part] @ times
                    of[1] += times.sum(axis=0)
                of[2] += float(x[at].sum())
                of[3] += len(at)
            if len(held) > MOST_CELLS:
                yield given()
                held.clear()
        if held:
            yield given()

    parts = known.mapInArrow(sums, schema)
    means = parts.groupBy("cell").agg((F.sum("total") / F.sum("rows")).alias("mean"))
    each = parts.select("cell", F.posexplode(F.arrays_zip("s", "n")).alias("resample", "z")).groupBy("cell", "resample").agg(F.try_divide(F.sum("z.s"), F.sum("z.n")).alias("m"))
    out = each.groupBy("cell").agg(F.percentile("m", F.lit(0.95)).alias("p")).join(means, "cell")
    return out.select(*[F.col(f"cell.{c}").alias(c) for c in cells], "mean", (F.col("p") - F.col("mean")).alias("error"))


def density_band(hist: DataFrame, draw_table: DataFrame, rows: int, columns: int, years: float) -> DataFrame:
    """(iy, mean, high): yearly mean count by row when columns are drawn with replacement, and its 95 % point."""
    spark = hist.sparkSession
    times = draw_table.groupBy("resample", F.col("idx").cast("int").alias("ix")).agg(F.count("*").alias("c"))
    drawn = hist.join(times, "ix").groupBy("resample", F.col("iy").cast("long").alias("iy")).agg(F.sum(F.col("c") * F.col("n")).alias("s"))
    spine = draw_table.select("resample").distinct().join(F.broadcast(spark.range(rows).select(F.col("id").alias("iy"))))
    means = spine.join(drawn, ["resample", "iy"], "left").withColumn("m", F.coalesce("s", F.lit(0)) / columns / years)
    return means.groupBy("iy").agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(0.95)).alias("high"))
