"""Near-duplicate documents by SimHash over word shingles, verified by the Jaccard similarity of their sets.

A text's set of shingles has a fingerprint of several 64-bit words. Texts meet in the grids of the segment popcounts of
each word (as in simhash.py), and link if the Hamming distance of their fingerprints allows it and their whole sets
are as similar as asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import materialize, release, shape, text_key
from .components import connected_components
from .simhash import _cut, _pairs_in_cells, _split, _work, keep_first_of_groups
from .textarrays import U64, chunks, give_back, lower, mix, prefix_hash, span_hash, words

WIDTH = 5
SIMILARITY = 0.8
_STEP = U64(0x9E3779B97F4A7C15)
_SLICE = 1 << 14
#: Bytes of texts that are cut into shingles at once; each takes several arrays of 8 bytes a byte.
_BYTES = 1 << 18
#: Sets of one candidate group that one task compares, or of each of two blocks of a larger group.
BLOCK = 1000


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the different shingles of each text, in order; a text of fewer words is one shingle."""
    data = lower(data)
    start, end, row = words(data, offsets)
    n = len(offsets) - 1
    token = span_hash(prefix_hash(data), start, end)
    per = np.bincount(row, minlength=n)
    many = np.where(per > 0, np.maximum(per - width + 1, 1), 0)
    owner = np.repeat(np.arange(n), many)
    at = np.arange(len(owner)) - (np.cumsum(many) - many)[owner] + (np.cumsum(per) - per)[owner]
    last = (np.cumsum(per) - 1)[owner]
    h = np.zeros(len(owner), dtype=U64)
    for k in range(width):
        inside = at + k <= last
        h[inside] = mix(h[inside] * _STEP + token[at[inside] + k])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    fresh = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, dtype=bool)
    return owner[fresh], h[fresh]


def _differing(similarity: float) -> float:
    """The chance that a bit differs between the SimHashes of two sets of equal size and this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _most_bits(similarity: float, bits: int) -> int:
    """Bits in which all but about 2% of such fingerprints differ at most."""
    p = _differing(similarity)
    return math.ceil(bits * p + 2 * math.sqrt(bits * p * (1 - p)))


def _plan(n: int, similarity: float) -> list:
    """Grids for ``n`` texts: three of each of three words, or, where their cells get crowded, two of each of thirteen.

    All have radius 2. Of pairs of similarity 0.8, 1.4% and 1.7% meet in none of them.
    """
    plans = [[g for w in range(count) for g in _cut(w, [2] * per)] for count, per in ((3, 3), (13, 2))]
    return min(plans, key=lambda grids: _work(grids, n))


def _prints(docs: DataFrame, width: int, count: int) -> DataFrame:
    """(id, text_key, fingerprint, size, words) of rows (id, text_key, text); equal sets have equal fingerprints."""
    schema = shape(docs.select("id", "text_key"), "fingerprint long, size int, words array<bigint>")
    salts = mix(np.arange(1, count + 1, dtype=U64) * _STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text"), _BYTES):
                n = len(offsets) - 1
                owner, h = _sets(data, offsets, width)
                size = np.bincount(owner, minlength=n)
                key, ones = np.zeros(n, dtype=U64), np.zeros((count, n, 64), dtype=np.int32)
                for i in range(0, len(h), _SLICE):
                    part, own = h[i : i + _SLICE], owner[i : i + _SLICE]
                    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    key[own[heads]] += np.add.reduceat(mix(part), heads)
                    for j, salt in enumerate(salts):
                        bits = np.unpackbits(mix(part ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        ones[j, own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
                packed = np.packbits(2 * ones > size[:, None], axis=2, bitorder="little").view(np.int64)[:, :, 0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * count), pa.array(packed.T.ravel()))
                part = slice(first, first + n)
                yield pa.RecordBatch.from_arrays([batch.column("id")[part], batch.column("text_key")[part], pa.array(key.view(np.int64)), pa.array(size.astype(np.int32)), lists], names=schema.names)
        give_back()

    return docs.mapInArrow(run, schema)


def _whole_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(fingerprint, shingles) of the texts whose fingerprints are in ``nodes`` (node); more may come."""
    wanted = docs.sparkSession.sparkContext.broadcast(bloom.plain(nodes.select(F.col("node").alias("key")), bloom.size_for(nodes.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        done = np.zeros(0, dtype=U64)
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text"), _BYTES):
                owner, h = _sets(data, offsets, width)
                heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(h) else np.zeros(0, dtype=np.int64)
                if not len(heads):
                    continue
                ends = np.append(heads[1:], len(h))
                keys, first = np.unique(np.add.reduceat(mix(h), heads), return_index=True)
                fresh = wanted.value.contains(keys) & ~np.isin(keys, done)
                keys, first = keys[fresh], first[fresh]
                done = np.union1d(done, keys)
                if len(keys):
                    bounds = np.append(0, np.cumsum(ends[first] - heads[first]))
                    held = np.concatenate([h[heads[i] : ends[i]] for i in first])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(held.view(np.int64)))], names=["fingerprint", "shingles"])
        give_back()

    return docs.select("text").mapInArrow(run, "fingerprint long, shingles array<bigint>").groupBy("fingerprint").agg(F.first("shingles").alias("shingles"))


def _forest(owner: np.ndarray, h: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the sets 0..k-1 (rows owner, h) that are as similar as asked."""
    starts = np.searchsorted(owner, np.arange(owner[-1] + 1))
    sizes = np.diff(np.append(starts, len(h)))
    values, place = np.unique(h, return_inverse=True)
    mark = np.zeros(len(values), dtype=bool)
    out, rest = [], np.ones(len(sizes), dtype=bool)
    for first in range(len(sizes)):
        if not rest[first]:
            continue
        front, rest[first] = [first], False
        while front and rest.any():
            i = front.pop()
            own = place[starts[i] : starts[i] + sizes[i]]
            mark[own] = True
            common = np.add.reduceat(mark[place], starts, dtype=np.int64)
            mark[own] = False
            for j in np.flatnonzero(rest & (common >= similarity * (sizes[i] + sizes - common))).tolist():
                out.append((i, j))
                front.append(j)
                rest[j] = False
    return out


def _links(near: DataFrame, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all sets as similar as asked, given what may be similar: (node, component).

    Each set goes once to its component, where sets are compared exactly; a component of more than BLOCK is cut into
    blocks, and goes once to each pair of them. Small components share groups.
    """
    near = materialize(near, "candidates")
    sets = _whole_sets(docs, near.select("node"), width).join(near, F.col("fingerprint") == F.col("node"))
    sets = materialize(sets.select("component", "node", "shingles"), "sets")
    sizes = sets.groupBy("component").agg(F.count("*").alias("size"))
    placed = sets.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bins = F.pmod(F.xxhash64("component"), F.lit(max(near.count() // BLOCK, 1)))
    group = F.when(F.col("blocks") > 1, F.col("component")).otherwise(bins)
    placed = placed.select("component", "node", "shingles", group.alias("g"), (F.col("blocks") > 1).alias("large"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        component, node = table.column("component").to_numpy(), table.column("node").to_numpy()
        lists = table.column("shingles").combine_chunks()
        bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        order = np.argsort(component, kind="stable")
        a, b = [], []
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
            sets = [flat[bounds[i] : bounds[i + 1]] for i in at]
            for i, j in _forest(np.repeat(np.arange(len(at)), [len(x) for x in sets]), np.concatenate(sets), similarity):
                a.append(node[at[i]])
                b.append(node[at[j]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("large", "g", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """(id, text_key, fingerprint, component_id): groups of documents linked by a Jaccard similarity of shingles.

    Equal sets are one class. No pair of sets less similar than ``similarity`` links; of those exactly as similar
    about 4% are missed as pairs, more similar ones hardly ever. Classes that meet in a grid and whose fingerprints
    are near form groups, by a spanning forest where many meet; within a group all sets are compared, exactly. Texts
    without words are one class. Null ids and repeated rows are treated as by simhash.near_duplicates.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    grids = _plan(rows.count(), similarity)
    marked = materialize(_prints(rows, width, 1 + max(g.word for g in grids)), "prints")
    classes = materialize(marked.groupBy("fingerprint").agg(F.min("id").alias("first_id"), F.first("size").alias("size"), F.first("words").alias("words")), "classes")
    own = classes.where("size > 0").select(F.col("fingerprint").alias("node"), "words")
    bits = ["next_word", "second_word"]
    near = materialize(_pairs_in_cells(_split(own, grids, bits), bits, _most_bits(similarity, 128), most=1).distinct(), "near")
    release(spark)
    linked = connected_components(_links(connected_components(near), rows, width, similarity))
    joined = classes.join(linked, classes.fingerprint == linked.node, "left").select("fingerprint", "first_id", "component")
    named = joined.where("component is not null").groupBy("component").agg(F.min("first_id").alias("smallest"))
    labelled = joined.join(named, "component", "left").select("fingerprint", F.coalesce("smallest", "first_id").alias("component_id"))
    return marked.select("id", "text_key", "fingerprint").join(labelled, "fingerprint").select("id", "text_key", "fingerprint", "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near_duplicates, chosen as by simhash.keep_one_of_each_group."""
    return keep_first_of_groups(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
