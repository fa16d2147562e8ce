"""Near-duplicate embeddings by NN-descent.

A graph of approximate nearest neighbours starts from blocks of vectors that fall together under random
hyperplanes, and is refined by joining the neighbours of each vector with one another. A brute-force audit on a
sample decides how long. Pairs above the threshold link; where links join more vectors than a neighbour list
holds, lists are enlarged to all vectors they connect, compared block by block. Vectors whose lists are full of
links may have more of them elsewhere: blocks of such vectors in different components are compared exactly, unless
their centres are too far apart for a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

NEIGHBOURS = 16
TABLES = 8
BLOCK = 48
MOST_ROUNDS = 8
AUDITED = 1024
RECALL = 0.98
#: Times that new hash tables, twice as many each time, are added where the audit finds too few links.
MOST_RESTARTS = 6
#: Fewer audited links than this tell nothing: refinement then goes on until under 1% of the lists change.
TELLING = 100
#: Half-precision cosines are wrong by less than this.
SLACK = 0.004
_COMPARE = 256
_SMALL = 64


def _usable(vec: str) -> F.Column:
    number = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec).isNotNull() & F.coalesce(number, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Unit rows, in double precision."""
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dims)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _halves(binary: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(binary.to_pylist()), dtype=np.float16).reshape(-1, dims).astype(np.float32)


def _best(similar: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest values of each row that are above -2."""
    k = min(k, similar.shape[1])
    top = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(similar)), k)
    column = top.ravel()
    real = similar[row, column] > -2
    return row[real], column[real]


def _pairs(a: list, b: list, s: list) -> pa.RecordBatch:
    empty = [np.zeros(0)]
    columns = [pa.array(np.concatenate(a or empty).astype(np.int64)), pa.array(np.concatenate(b or empty).astype(np.int64)), pa.array(np.concatenate(s or empty).astype(np.float32))]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "sim"])


def _first_graph(codes: DataFrame, dims: int, n: int, k: int, tables: int, seed: int) -> DataFrame:
    """(a, b, sim): the nearest of each vector among those next to it in the order of each hash table.

    Rows are dealt by ranges of (table, hash, projection), so a crowded hash is split like any other range.
    """
    bits = max(1, int(np.ceil(np.log2(max(n / 20, 2)))))
    planes = np.random.default_rng(seed).standard_normal((tables, min(bits, 30) + 1, dims)).astype(np.float32)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(planes.shape[1] - 1)
        for batch in batches:
            x = _halves(batch.column("code"), dims)
            for t in range(tables):
                y = x @ planes[t].T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, dtype=np.int32)), pa.array((y[:, :-1] > 0) @ power), pa.array(y[:, -1]), batch.column("node"), batch.column("code")], names=["t", "bucket", "along", "node", "code"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, node, table = _halves(batch.column("code"), dims), batch.column("node").to_numpy(), batch.column("t").to_numpy()
            a, b, s = [], [], []
            for i in range(0, len(x), BLOCK):
                similar = x[i : i + BLOCK] @ x[i : i + BLOCK].T
                np.fill_diagonal(similar, -2)
                similar[table[i : i + BLOCK, None] != table[None, i : i + BLOCK]] = -2
                row, column = _best(similar, k)
                a.append(node[i + row])
                b.append(node[i + column])
                s.append(similar[row, column])
            yield _pairs(a, b, s)

    parts = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = codes.mapInArrow(place, "t int, bucket long, along float, node long, code binary")
    return placed.repartitionByRange(parts, "t", "bucket", "along").sortWithinPartitions("t", "bucket", "along").mapInArrow(blocks, "a long, b long, sim float")


def _kept(pairs: DataFrame, k: int) -> DataFrame:
    """The k best neighbours b of each a; a pair that was there before is not new."""
    one = pairs.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return one.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("r") <= k).drop("r")


def _refined(graph: DataFrame, codes: DataFrame, dims: int, k: int) -> DataFrame:
    """A better graph: neighbours (either way round) of each vector are compared with one another."""
    bars = graph.groupBy("a").agg(F.min("sim").alias("low"), F.count("*").alias("n")).select(F.col("a").alias("v"), F.when(F.col("n") >= k, F.col("low")).otherwise(F.lit(-1.0)).cast("float").alias("bar"))
    back = graph.select(F.col("b").alias("u"), F.col("a").alias("v"), "new", "sim")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("new"), F.desc("sim"), "v"))).where(F.col("r") <= k).select("u", "v", "new")
    edges = graph.select(F.col("a").alias("u"), F.col("b").alias("v"), "new").union(back).groupBy("u", "v").agg(F.max("new").alias("new"))
    told = codes.select(F.col("node").alias("v"), "code").join(bars, "v", "left").withColumn("bar", F.coalesce("bar", F.lit(-1.0).cast("float")))
    lists = edges.join(told, "v").groupBy("u").agg(F.collect_list(F.struct("v", "new", "bar", "code")).alias("m"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("m")
            bounds, flat = np.append(0, np.cumsum(lists.value_lengths().to_numpy())), lists.flatten()
            v, new, bar = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("v", "new", "bar"))
            x = _halves(flat.field("code"), dims)
            a, b, s = [], [], []
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                fresh = new[i:j] == 1
                if j - i < 2 or not fresh.any():
                    continue
                similar = x[i:j] @ x[i:j].T
                np.fill_diagonal(similar, -2)
                similar[np.ix_(~fresh, ~fresh)] = -2
                similar[similar <= bar[i:j, None]] = -2
                row, column = _best(similar, 5)
                a.append(v[i + row])
                b.append(v[i + column])
                s.append(similar[row, column])
            yield _pairs(a, b, s)

    found = lists.select("m").mapInArrow(join, "a long, b long, sim float").withColumn("new", F.lit(1))
    return _kept(graph.withColumn("new", F.lit(0)).unionByName(found), k)


def _audit(codes: DataFrame, vectors: DataFrame, dims: int, n: int, threshold: float, audited: int) -> DataFrame:
    """(node, links, times): the true numbers of links of a hash sample of vectors, by brute force against all.

    links counts different vectors, times the rows that hold them.
    """
    draw = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) / float(1 << 30)
    sample = vectors.where(draw < min(1.0, audited / max(n, 1))).select("node", "embedding").toArrow().combine_chunks()
    ids = sample.column("node").to_numpy()
    y = _matrix(sample.column("embedding").combine_chunks(), dims) if len(ids) else np.zeros((0, dims))
    shared = codes.sparkSession.sparkContext.broadcast((ids, y))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = shared.value
        for batch in batches:
            x, node, n = _matrix(batch.column("embedding"), dims), batch.column("node").to_numpy(), batch.column("n").to_numpy()
            hits, times = np.zeros(len(ids), dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
            for i in range(0, len(x), 2048):
                near = (x[i : i + 2048] @ y.T >= threshold) & (node[i : i + 2048, None] != ids)
                hits += near.sum(0)
                times += n[i : i + 2048] @ near
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hits), pa.array(times)], names=["node", "links", "times"])

    counted = vectors.select("node", "embedding", "n").mapInArrow(count, "node long, links long, times long")
    return counted.groupBy("node").agg(F.sum("links").alias("links"), F.sum("times").alias("times"))


def _verified(near: DataFrame, vectors: DataFrame, dims: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose cosine in double precision reaches the threshold."""
    pairs = near.join(vectors.select(F.col("node").alias("a"), F.col("embedding").alias("x")), "a").join(vectors.select(F.col("node").alias("b"), F.col("embedding").alias("y")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = (_matrix(batch.column("x"), dims) * _matrix(batch.column("y"), dims)).sum(1)
            yield batch.select(["a", "b"]).filter(pa.array(cosine >= threshold))

    return pairs.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _pairs_of_groups(rows: DataFrame, group: str, groups: int) -> DataFrame:
    """``rows`` once for each pair (i, j) of groups that holds its own."""
    other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return other.withColumn("i", F.least(group, "other")).withColumn("j", F.greatest(group, "other")).drop("other")


def _cross_links(graph: DataFrame, vectors: DataFrame, components: DataFrame, dims: int, k: int, threshold: float) -> DataFrame | None:
    """(a, b): a link between any two components that full lists may have kept apart, None if there is but one.

    A link that is in neither list has an end with a full list of links on both sides, so only such vectors are
    compared: in blocks of about _COMPARE of one component, all pairs of blocks of different components whose
    centres lie no farther apart than both radii and the angle of the threshold.
    """
    full = graph.groupBy("a").agg(F.min("sim").alias("low"), F.count("*").alias("size")).where((F.col("size") >= k) & (F.col("low") >= threshold - SLACK))
    own = F.coalesce("component", "node").alias("component")
    crowded = materialize(full.select(F.col("a").alias("node")).join(components, "node", "left").select("node", own), "crowded")
    sizes = materialize(crowded.groupBy("component").agg(F.count("*").alias("size")), "sizes")
    n, n_blocks, n_components = sizes.agg(F.sum("size"), F.sum(F.ceil(F.col("size") / _COMPARE)), F.count("*")).first()
    if n_components < 2:
        return None
    block = F.xxhash64("component", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / _COMPARE).cast("int"))).alias("block")
    placed = materialize(crowded.join(sizes, "component").select("node", "component", block).join(vectors.select("node", "embedding"), "node"), "blocks")

    def ball(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, block, component = _matrix(table.column("embedding").combine_chunks(), dims), table.column("block").to_numpy(), table.column("component").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
        centres, radii = [], []
        for p in np.split(order, cuts[1:]):
            c = x[p].sum(0)
            c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-9 else x[p[0]]
            centres.append(c)
            radii.append(float(np.arccos(np.clip((x[p] @ c).min(), -1, 1))))
        heads = order[cuts]
        return pa.table({"block": block[heads], "component": component[heads], "centre": pa.array(list(np.array(centres)), pa.list_(pa.float64())), "radius": radii})

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, radius = _matrix(table.column("centre").combine_chunks(), dims), table.column("radius").to_numpy()
        block, component, part = (table.column(c).to_numpy() for c in ("block", "component", "part"))
        p, q = np.flatnonzero(part == i), np.flatnonzero(part == j)
        apart = np.arccos(np.clip(x[p] @ x[q].T, -1, 1)) - radius[p][:, None] - radius[q]
        close = (apart <= np.arccos(threshold) + 1e-6) & (component[p][:, None] != component[q])
        if i == j:
            close &= block[p][:, None] < block[q]
        a, b = np.nonzero(close)
        return pa.table({"x": block[p[a]], "y": block[q[b]]})

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x, node, block = _matrix(table.column("embedding").combine_chunks(), dims), table.column("node").to_numpy(), table.column("block").to_numpy()
        first = block == table.column("x")[0].as_py()
        a, b = node[first], node[~first]
        near = np.flatnonzero((x[first] @ x[~first].T >= threshold).ravel())[:1]
        return pa.table({"a": np.minimum(a[near // len(b)], b[near % len(b)]), "b": np.maximum(a[near // len(b)], b[near % len(b)])})

    bins = F.pmod(F.col("block"), F.lit(max(int(n // 1000), 1)))
    balls = placed.groupBy(bins).applyInArrow(ball, "block long, component long, centre array<double>, radius double")
    parts = int(-(-n_blocks // 2048))
    dealt = _pairs_of_groups(balls.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)).cast("int")), "part", parts)
    close = materialize(dealt.groupBy("i", "j").applyInArrow(meet, "x long, y long"), "close")
    ends = close.select("x", "y", F.explode(F.array("x", "y")).alias("block"))
    return ends.join(placed, "block").select("x", "y", "block", "node", "embedding").groupBy("x", "y").applyInArrow(compare, "a long, b long")


def _link_counts(members: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(node, links): for (component, node, n, embedding), the rows of the component that each node links.

    A component of more than _COMPARE vectors is cut into blocks by hash, and each pair of blocks is one group;
    small components share groups. Only counts are written, never pairs.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size"))
    placed = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / _COMPARE).cast("int"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    placed = placed.withColumn("own", block).withColumn("other", other)
    small = F.col("size") <= _SMALL
    bins = F.pmod(F.xxhash64("component"), F.lit(max(int(members.count() // 1000), 1)))
    placed = placed.select("node", "n", "embedding", "component", "own", F.when(small, bins).otherwise(F.col("component")).alias("g"), small.alias("small"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = _matrix(table.column("embedding").combine_chunks(), dims)
        node, n, component, own = (table.column(c).to_numpy() for c in ("node", "n", "component", "own"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        links = np.zeros(len(node), dtype=np.int64)
        if table.column("small")[0].as_py():
            order = np.argsort(component, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(component[order]) != 0))
            parts = [(p, p) for p in np.split(order, cuts[1:])]
        else:
            parts = [(np.flatnonzero(own == i), np.flatnonzero(own == j))]
        for p, q in parts:
            near = x[p] @ x[q].T >= threshold
            near &= node[p][:, None] != node[q]
            links[p] += near @ n[q]
            if i != j:
                links[q] += near.T @ n[p]
        return pa.table({"node": node, "links": links})

    return placed.groupBy("small", "g", "i", "j").applyInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, neighbours: int = NEIGHBOURS, tables: int = TABLES, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector; links are pairs of cosine >= ``threshold``.

    Vectors that are null, zero or hold null or non-finite parts, and those with a null id, link with nothing. Vectors
    of each length are compared with one another, a length at a time. Equal vectors are one class in the graph and
    are counted as often as they occur (rows that repeat an id too). No pair below the threshold is linked; the share
    of all links found is audited by brute force on a sample, and hash tables and rounds are added until it reaches
    ``recall``; where it does not, an error is raised. An empty table gives an empty result; other columns are not
    read.
    """
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
    good = F.coalesce(_usable("embedding") & F.col("id").isNotNull(), F.lit(False))
    out = rows.where(~good).select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    for r in rows.where(good).groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
        out = out.union(_of_one_length(rows.where(good & (F.size("embedding") == r["d"])), r["d"], threshold, neighbours, tables, recall, seed))
    return out.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def _of_one_length(rows: DataFrame, dims: int, threshold: float, neighbours: int, tables: int, recall: float, seed: int) -> DataFrame:
    """(id, links, component) of usable vectors of ``dims`` parts."""
    vectors = materialize(rows.groupBy("embedding").agg(F.min("id").alias("node"), F.count("*").alias("n")), "vectors")
    n = vectors.count()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"), dims).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([v.tobytes() for v in x], pa.binary())], names=["node", "code"])

    codes = materialize(vectors.select("node", "embedding").mapInArrow(encode, "node long, code binary"), "codes")
    graph = materialize(_kept(_first_graph(codes, dims, n, neighbours, tables, seed).withColumn("new", F.lit(1)), neighbours), "graph")
    truth = materialize(_audit(codes, vectors, dims, n, threshold, AUDITED), "audit")
    wanted, wanted_times = (x or 0 for x in truth.agg(F.sum(F.least("links", F.lit(neighbours))), F.sum("times")).first())
    for restart in range(1, MOST_RESTARTS + 1):
        for _ in range(MOST_ROUNDS):
            graph = materialize(_refined(graph, codes, dims, neighbours), "graph")
            linked = graph.where(F.col("sim") >= threshold).join(truth, F.col("a") == F.col("node"), "left_semi").count()
            if linked >= recall * wanted and (wanted >= TELLING or graph.where("new = 1").count() <= 0.01 * n * neighbours):
                break
        near = graph.where(F.col("sim") >= threshold - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = materialize(_verified(near, vectors, dims, threshold), "links")
        components = materialize(connected_components(links), "components")
        crossing = _cross_links(graph, vectors, components, dims, neighbours, threshold)
        if crossing is not None:
            components = materialize(connected_components(links.union(crossing)), "components")
        members = components.join(vectors, "node").select("component", "node", "n", "embedding")
        counts = materialize(_link_counts(members, dims, threshold), "counts")
        found_times = counts.join(truth.select("node"), "node").agg(F.sum("links")).first()[0] or 0
        if found_times >= recall * wanted_times:
            break
        more = _first_graph(codes, dims, n, neighbours, tables << restart, seed + restart).withColumn("new", F.lit(1))
        graph = materialize(_kept(graph.unionByName(more), neighbours), "graph")
    else:
        raise RuntimeError("near_duplicates: the audit found too few links within MOST_RESTARTS")
    told = vectors.select("embedding", "node", "n").join(components, "node", "left").join(counts, "node", "left")
    told = told.select(F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("links"), F.coalesce("component", "node").alias("component"))
    return rows.join(told, rows["embedding"] == told["e"]).select("id", "links", "component")
