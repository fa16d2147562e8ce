"""Near-duplicate documents by SimHash fingerprints and a range join over segment popcounts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shape, text_key
from .components import connected_components
from .textarrays import U64, chunks, lower, mix

#: The even bits: one of each two-bit segment.
_EVEN = U64(0x5555555555555555)
_BLOCK = 1 << 16


def _fingerprint(text: bytes, width: int, seed: int) -> int:
    """SimHash of lower-cased bytes over shingles of ``width`` words; 0 without words."""
    found = text.split()
    if not found:
        return 0
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    end = np.cumsum(lengths + 1) - 1
    start = end - lengths
    n = max(len(found) - width + 1, 1)
    stop = end[width - 1 :] if len(found) >= width else end[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, _BLOCK):
        spans = zip(start[k : min(k + _BLOCK, n)].tolist(), stop[k : k + _BLOCK].tolist(), strict=True)
        hashes = np.array([digest(joined[i:j], seed) for i, j in spans], dtype=np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, text_key, fingerprint long), a row for each input row.

    Null and empty texts, and texts of white space only, have fingerprint 0; a text of fewer words than
    ``width`` is one shingle. Repeated shingles count as often as they occur.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    schema = shape(rows.select("id", "text_key"), "fingerprint long")
    names = ["id", "text_key", "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[int] = []
            for _, data, offsets in chunks(batch.column("text")):
                low = lower(data).tobytes()
                out += [_fingerprint(low[i:j], width, seed) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_key"), pa.array(out, pa.int64())], names=names)

    return rows.mapInArrow(run, schema)


def segment_popcounts(fingerprints: np.ndarray) -> np.ndarray:
    """The 32 popcounts (0, 1 or 2) of the two-bit segments, as the two-bit digits of one number."""
    low, high = fingerprints & _EVEN, (fingerprints >> U64(1)) & _EVEN
    return ((low & high) << U64(1)) | (low ^ high)


class Grid:
    """Cells of the popcounts of some segments of one fingerprint word.

    Words within Manhattan distance ``radius`` there share a cell: with radius 1 each word lies in its own cell and
    in those one step up along an axis, with radius 2 in its own and in those one step up or down (two words meet
    half way).
    """

    def __init__(self, word: int, segments: list[int], radius: int):
        self.word, self.segments, self.radius = word, segments, radius
        self.mask = U64(sum(3 << (2 * s) for s in segments))

    def cells(self, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, cells) of each step; the own cells come first. Two cells of one 32-bit number are compared as one."""
        own, salt = counts & self.mask, mix(np.array([self.word * 64 + self.segments[0]], dtype=U64))
        rows = np.arange(len(counts))
        out = [(rows, mix(own ^ salt) >> U64(32))]
        for s in self.segments if self.radius else []:
            digit = (counts >> U64(2 * s)) & U64(3)
            # one step between 0 and 1 flips the low bit of a digit, one between 1 and 2 both
            for moves, flips_low in ((digit < 2, digit == 0), *([(digit > 0, digit == 1)] if self.radius > 1 else [])):
                at = rows[moves]
                step = np.where(flips_low[at], U64(1 << (2 * s)), U64(3 << (2 * s)))
                out.append((at, mix((own[at] ^ step) ^ salt) >> U64(32)))
        return out


def _cut(word: int, radii: list[int]) -> list[Grid]:
    cuts = np.linspace(0, 32, len(radii) + 1).round().astype(int)
    return [Grid(word, list(range(i, j)), r) for i, j, r in zip(cuts[:-1], cuts[1:], radii, strict=True)]


def exact_grids(max_distance: int, n: int) -> list[Grid]:
    """Grids of one word in which each pair within ``max_distance`` bits meets, for ``n`` fingerprints.

    Were the Manhattan distance above the radius in every grid, the sum would exceed max_distance, as the radii
    plus one add up to max_distance + 1. Fewer grids of radius 2 have rarer cells and more rows, which pays in
    large tables.
    """
    fine = [1] * ((max_distance + 1) // 2) + [0] * ((max_distance + 1) % 2)
    coarse = [2] * ((max_distance + 1) // 3) + [(max_distance + 1) % 3 - 1] * ((max_distance + 1) % 3 > 0)
    return _cut(0, min((fine, coarse), key=lambda radii: _work(_cut(0, radii), n)))


def _work(grids: list[Grid], n: int) -> float:
    """Rows of all cells and, 200 of which cost about as much, comparisons of random fingerprints."""
    rows, chance = 0.0, 0.0
    for g in grids:
        m = len(g.segments)
        rows += 1 + (0, 0.75, 1.5)[g.radius] * m
        meets = [(3 / 8) ** m, m / 2 * (3 / 8) ** (m - 1) if m else 0, (m * (m - 1) / 8 * (3 / 8) ** (m - 2) + m / 8 * (3 / 8) ** (m - 1)) if m > 1 else 0]
        chance += sum(meets[: g.radius + 1])
    return n * rows + n * n / 2 * chance / 200


#: Distinct fingerprints of one cell beyond which it is split into pairs of blocks.
CROWDED = 50_000
_SMALL = 32


def _members(rows: DataFrame, grids: list[Grid], bits: list[str], own_only: bool = False) -> DataFrame:
    """(cell, node, *bits) of each row (node, words array<bigint>) for each cell that it lies in.

    ``bits`` names columns for the words that come after the one that the cell was made from, in a ring.
    """
    names = ["node", "cell", *bits]
    schema = ", ".join(f"{c} long" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_ = batch.column("words").flatten().to_numpy(zero_copy_only=False).view(U64).reshape(len(batch), -1)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for g in grids:
                steps = g.cells(segment_popcounts(words_[:, g.word]))[: 1 if own_only else None]
                at, cell = np.concatenate([r for r, _ in steps]), np.concatenate([c for _, c in steps])
                others = [words_[at, (g.word + i) % words_.shape[1]] for i in range(1, len(bits) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), *(pa.array(x.view(np.int64)) for x in (cell, *others))], names=names)

    return rows.select("words", "node").mapInArrow(run, schema)


def _split(rows: DataFrame, grids: list[Grid], bits: list[str]) -> DataFrame:
    """_members, where a cell of more than CROWDED is one for each pair of its blocks."""
    members = _members(rows, grids, bits)
    own = _members(rows, grids, [], own_only=True).groupBy("cell").count().where(F.col("count") > CROWDED / 32)
    if own.isEmpty():
        return members
    sizes = members.groupBy("cell").count().where(F.col("count") > CROWDED).select("cell", F.ceil(F.col("count") / CROWDED).cast("int").alias("blocks"))
    placed = members.join(sizes, "cell", "left").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other_block", F.explode(F.coalesce(F.sequence(F.lit(0), F.col("blocks") - 1), F.array(F.lit(0)))))
    pair = F.xxhash64("cell", F.least("block", "other_block"), F.greatest("block", "other_block"))
    return placed.withColumn("cell", F.when(F.col("blocks").isNull(), F.col("cell")).otherwise(pair)).select(members.columns)


def _apart(x: list[np.ndarray], p: np.ndarray | slice, q: np.ndarray | slice) -> np.ndarray:
    """Differing bits between each of p and each of q."""
    return sum(np.bitwise_count(b[p][:, None] ^ b[q]).astype(np.int16) for b in x)


def _near_in_cell(x: list[np.ndarray], limit: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions within ``limit`` bits: all, or a spanning forest if there are over ``most`` a position."""
    a, b, found = [], [], 0
    for i in range(0, len(x[0]), 256):
        p, q = np.nonzero(_apart(x, slice(i, i + 256), slice(i, None)) <= limit)
        later = p < q
        a.append(i + p[later])
        b.append(i + q[later])
        found += len(a[-1])
        if found > most * len(x[0]):
            return _forest(x, limit)
    return np.concatenate(a), np.concatenate(b)


def _forest(x: list[np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs within ``limit`` bits."""
    none = np.zeros(0, dtype=np.int64)
    a, b, rest = [none], [none], np.arange(len(x[0]))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:64], front[64:]
            near = _apart(x, now, rest) <= limit
            hit = near.any(0)
            a.append(now[near.argmax(0)[hit]])
            b.append(rest[hit])
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    return np.concatenate(a), np.concatenate(b)


def _pairs_in_cells(members: DataFrame, bits: list[str], limit: int, most: int = 8) -> DataFrame:
    """Pairs (a, b) of nodes that share a cell and differ in at most ``limit`` of the ``bits``.

    A cell's pairs are all compared, and where over ``most`` for each member are near, a spanning forest of them is
    given: a large group of near fingerprints costs rows in proportion to its size, and what is reachable stays so.
    Forests grow from the smallest nodes, so those of a group's many cells have most of their pairs in common.
    """
    columns = list(dict.fromkeys(["cell", "node", *bits]))
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.select(*columns).repartition(parts, "cell").sortWithinPartitions("cell")

    def told(held: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
        rows = {c: np.concatenate([h[c] for h in held]) for c in columns}
        cell, node, x = rows["cell"], rows["node"], [rows[c].view(U64) for c in bits]
        heads = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        sizes = np.diff(np.append(heads, len(cell)))
        none = np.zeros(0, dtype=np.int64)
        a, b = [none], [none]
        at = np.flatnonzero(np.repeat(sizes <= _SMALL, sizes))
        for d in range(1, min(_SMALL, int(sizes.max()))):
            p, q = at[:-d], at[d:]
            p, q = p[cell[p] == cell[q]], q[cell[p] == cell[q]]
            near = sum(np.bitwise_count(y[p] ^ y[q]).astype(np.int16) for y in x) <= limit
            a.append(p[near])
            b.append(q[near])
        a, b = np.concatenate(a), np.concatenate(b)
        place = np.repeat(np.arange(len(sizes)), sizes)
        whole = (sizes > _SMALL) | (np.bincount(place[a], minlength=len(sizes)) > most * sizes)
        a, b = [node[a[~whole[place[a]]]]], [node[b[~whole[place[a]]]]]
        for i in np.flatnonzero(whole).tolist():
            part = heads[i] + np.argsort(node[heads[i] : heads[i] + sizes[i]])
            p, q = _near_in_cell([y[part] for y in x], limit, most)
            a.append(node[part[p]])
            b.append(node[part[q]])
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
            held.append(new)
            size += len(batch)
            # a cell is compared once its last row is there
            last = int(np.searchsorted(new["cell"], new["cell"][-1])) if len(batch) else 0
            if size > 1 << 17 and last:
                yield told([*held[:-1], {c: y[:last] for c, y in new.items()}])
                held, size = [{c: y[last:] for c, y in new.items()}], len(batch) - last
        if size:
            yield told(held)

    return dealt.mapInArrow(run, "a long, b long")


def similar_fingerprints(distinct: DataFrame, max_distance: int = 4, n: int | None = None) -> DataFrame:
    """Links (a, b) between different fingerprints that differ in at most ``max_distance`` bits.

    The Manhattan distance between segment popcounts is a lower bound of the Hamming distance, so each such pair
    meets in a cell, where it is verified exactly. Pairs of a crowded cell may be given as a spanning forest: what
    is reachable by links stays so.
    """
    grids = exact_grids(max_distance, distinct.count() if n is None else n)
    rows = distinct.select(F.col("fingerprint").alias("node"), F.array("fingerprint").alias("words"))
    return _pairs_in_cells(_split(rows, grids, []), ["node"], max_distance)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, max_distance: int = 4, seed: int = 42) -> DataFrame:
    """(id, text_key, fingerprint, component_id): groups of documents whose fingerprints link.

    component_id is the smallest id reachable through links, the document's own included. Documents with equal
    fingerprints form one class before any join, so a large group of copies is one row there. A null id is in
    its group but never names it (unless all ids of the group are null); repeated rows all appear; an empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    classes = materialize(marked.groupBy("fingerprint").agg(F.min("id").alias("first_id")), "classes")
    linked = connected_components(similar_fingerprints(classes, max_distance))
    joined = classes.join(linked, classes.fingerprint == linked.node, "left").select("fingerprint", "first_id", "component")
    named = joined.where("component is not null").groupBy("component").agg(F.min("first_id").alias("smallest"))
    labelled = joined.join(named, "component", "left").select("fingerprint", F.coalesce("smallest", "first_id").alias("component_id"))
    return marked.join(labelled, "fingerprint").select("id", "text_key", "fingerprint", "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, all columns kept.

    The document with the smallest id stays (among rows of that id the smallest text hash, and one of rows that
    repeat both); a group whose ids are all null keeps one row by text hash.
    """
    return keep_first_of_groups(docs, near_duplicates(docs, id_col, text_col, max_distance=max_distance), id_col, text_col)


def keep_first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that keep_one_of_each_group keeps of ``groups`` (id, text_key, fingerprint, component_id)."""
    order = F.struct(F.col("id").isNull().alias("_no"), F.col("id").alias("_id"), F.col("text_key").alias("_key"))
    stay = groups.groupBy(F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("f"), F.col("fingerprint").cast("string"))).alias("_g")).agg(F.min(order).alias("_o"))

    def key(id_: Column, text: Column) -> dict[str, Column]:
        return {"_tidemark_null": id_.isNull(), "_tidemark_id": F.coalesce(id_.cast("string"), F.lit("")), "_tidemark_key": text}

    # one key for the join and for what repeats, so texts are shuffled once
    named = key(F.col("_o._id"), F.col("_o._key"))
    kept = docs.withColumns(key(F.col(id_col), text_key(F.col(text_col)))).join(stay.select(*[c.alias(n) for n, c in named.items()]), list(named), "left_semi")
    return kept.dropDuplicates(list(named)).select(*docs.columns)
