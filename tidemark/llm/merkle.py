"""A Merkle manifest of a dataset: ternary hash trees by source and over sources, with a proof for every row."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shape

FAN = 3
#: Levels of a band. A block is the part of a band below one of its topmost nodes: FAN ** BAND leaves at most.
BAND = 6


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def ranked(df: DataFrame, tree: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with rank (long, from 0) and size (long) within each ``tree``, as written to the shared folder.

    Rows are dealt by ranges of (tree, order), so a large tree lies in many partitions; only its number of rows in
    each partition is summed up. Null sorts first. Ties of the whole order are ranked in any order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *tree, *order).sortWithinPartitions(*tree, *order)
    dealt = materialize(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(*tree, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    one = Window.partitionBy(*tree)
    counts = counts.withColumns({"_before": F.sum("_n").over(one.orderBy("_part")) - F.col("_n"), "size": F.sum("_n").over(one)})
    keys = [F.col(c).alias(f"_key{i}") for i, c in enumerate(tree)]
    counts = counts.select(*keys, F.col("_part").alias("_key_part"), "_first", "_before", "size")
    same = part == F.col("_key_part")
    for i, c in enumerate(tree):
        same &= F.col(c).eqNullSafe(F.col(f"_key{i}"))
    return dealt.join(counts, same).withColumn("rank", F.col("_before") + F.col("_at") - F.col("_first")).select(*df.columns, "rank", "size")


def height(size: int) -> int:
    """Levels above the leaves of a tree."""
    levels, width = 0, 1
    while width < size:
        levels, width = levels + 1, width * FAN
    return levels


class Block:
    """The nodes over consecutive leaves of a band, each with the interval of leaf ranks that it covers."""

    def __init__(self, digests: list[str], levels: int):
        self.levels = [[(i, i + 1, d) for i, d in enumerate(digests)]]
        for _ in range(levels):
            below, here = self.levels[-1], []
            for i in range(0, len(below), FAN):
                run = below[i : i + FAN]
                here.append((run[0][0], run[-1][1], hashlib.sha256("".join(d for _, _, d in run).encode()).hexdigest()))
            self.levels.append(here)

    def top(self) -> str:
        return self.levels[-1][0][2]

    def siblings(self, rank: int) -> list[str]:
        """Left and right sibling digests of each level's ancestor of a leaf, joined: what its parent's interval covers and its own does not."""
        out, at = [], rank
        for below, above in zip(self.levels, self.levels[1:], strict=False):
            low, high, _ = below[at]
            start, stop, _ = above[at // FAN]
            left = right = ""
            for a, b, digest in below[at // FAN * FAN : at // FAN * FAN + FAN]:
                if start <= a and b <= low:
                    left += digest
                elif high <= a and b <= stop:
                    right += digest
            out += [left, right]
            at //= FAN
        return out


def _block(band: int) -> Column:
    return F.expr(f"rank div {FAN**band}")


def _dealt(leaves: DataFrame, tree: list[str], band: int) -> DataFrame:
    """Leaves of a band, those of one block in one partition and in order of rank."""
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return leaves.repartition(n, *tree, _block(band)).sortWithinPartitions(*tree, "rank")


def _blocks(batches: Iterator[pa.RecordBatch], tree: list[str], band: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(tree and number of the block, rows) of rows as _dealt() sorts them; a block may lie in several batches."""
    open_key, parts = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in tree]
        keys = list(zip(*columns, [r // FAN**band for r in batch.column("rank").to_pylist()], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if keys[start] != open_key:
                if parts:
                    yield open_key, pa.Table.from_batches(parts)
                open_key, parts = keys[start], []
            parts.append(batch.slice(start, i - start))
            start = i
    if parts:
        yield open_key, pa.Table.from_batches(parts)


def bands(leaves: DataFrame, tree: list[str], band: int, name: str) -> list[DataFrame]:
    """The leaves of each band of every tree, from the lowest: (tree, rank, size, lo, hi, digest).

    The leaves of a band above the first are the topmost nodes of the band below; ``lo`` and ``hi`` tell the ranks
    of the tree's leaves that a node covers. ``leaves`` has these columns, and may have more. The last item has one
    row for each tree, its root.
    """
    schema = shape(leaves.select(*tree), "rank long, size long, lo long, hi long, digest string")

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, kinds = [], None

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=kinds)

        for key, block in _blocks(batches, tree, band):
            kinds = kinds or pa.schema([block.schema.field(c) for c in schema.names])
            size = block.column("size")[0].as_py()
            top = Block(block.column("digest").to_pylist(), min(band, height(size))).top()
            out.append((*key, -(-size // FAN**band), block.column("lo")[0].as_py(), block.column("hi")[-1].as_py(), top))
            if len(out) == 10000:
                yield rows()
                out.clear()
        if out:
            yield rows()

    found = [leaves]
    while len(found) == 1 or (found[-1].agg(F.max("size")).first()[0] or 1) > 1:
        found.append(materialize(_dealt(found[-1].select(*schema.names), tree, band).mapInArrow(tops, schema), f"{name}{len(found)}"))
    return found


def with_siblings(found: list[DataFrame], tree: list[str], band: int, roots: DataFrame, given: list[str]) -> DataFrame:
    """The leaves of the lowest band with ``steps`` (left and right siblings of each ancestor, from the leaf to the root) and ``given``.

    ``roots`` has a row for each tree, with the steps above its root and the columns ``given``, which all its leaves
    get. From the highest band down, each block of a band is joined with the node of the band above whose interval
    contains those of its leaves; the bucket of the join is that node's rank. A block is joined by its first leaf,
    so the steps above a block travel once. What is beside an ancestor inside the block is the difference of
    intervals (Block.siblings).
    """
    above = roots.withColumns({"rank": F.lit(0).cast("long"), "lo": F.lit(0).cast("long"), "hi": F.lit((1 << 63) - 1)})
    passed = ["steps", *given]
    for i in range(len(found) - 2, -1, -1):
        leaves = found[i]
        schema = shape(leaves.join(above.select(*passed), F.lit(False)))

        def attached(batches: Iterator[pa.RecordBatch], names: list[str] = schema.names) -> Iterator[pa.RecordBatch]:
            for _, rows in _blocks(batches, tree, band):
                block = Block(rows.column("digest").to_pylist(), min(band, height(rows.column("size")[0].as_py())))
                outer = rows.column("steps")[0].as_py()
                columns = {c: rows.column(c) for c in names}
                columns["steps"] = pa.array([block.siblings(k) + outer for k in range(len(rows))], rows.schema.field("steps").type)
                for c in given:
                    columns[c] = pa.repeat(rows.column(c)[0], len(rows))
                yield from pa.table(columns).to_batches()

        outer = above.select(F.struct(*tree).alias("_tree"), F.col("rank").alias("_rank"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), *passed)
        inside = (F.struct(*tree) == F.col("_tree")) & (_block(band) == F.col("_rank")) & (F.col("_lo") <= F.col("lo")) & (F.col("hi") <= F.col("_hi"))
        first = leaves.where(f"rank % {FAN**band} = 0").join(outer, inside).select(*schema.names)
        others = leaves.where(f"rank % {FAN**band} > 0").select("*", *[F.lit(None).cast(schema[c].dataType).alias(c) for c in passed])
        above = _dealt(first.unionByName(others), tree, band).mapInArrow(attached, schema)
        if i:
            above = materialize(above, f"steps{i}")
    return above


def manifest(leaves: DataFrame, tree: list[str], order: list[str], band: int = BAND) -> DataFrame:
    """``leaves`` with rank, size, lo, hi, steps, subroot and root: their place in the tree of their source and the proof.

    ``tree`` names the columns that tell trees apart, ``order`` those that order the leaves within one; ``digest``
    is the leaf's. Every FAN consecutive nodes, the last run fewer, become one until one is left; the roots, in
    order of ``tree``, null first, form a tree in the same way. Both hold at any number of rows, trees and
    levels: no task holds more than a block and a batch. Equal rows are leaves of their own; an empty table gives
    an empty result.
    """
    interval = {"lo": F.col("rank"), "hi": F.col("rank") + 1}
    found = bands(materialize(ranked(leaves, tree, order, "leaves").withColumns(interval), "ranked"), tree, band, "band")
    subroots = found[-1].select(*tree, "digest").withColumn("_all", F.lit(0))
    over = bands(ranked(subroots, ["_all"], tree, "subroots").withColumns(interval), ["_all"], band, "top")
    root = over[-1].select("_all", F.array().cast("array<string>").alias("steps"), F.col("digest").alias("root"))
    proved = materialize(with_siblings(over, ["_all"], band, root, ["root"]).select(*tree, "steps", F.col("digest").alias("subroot"), "root"), "roots")
    return with_siblings(found, tree, band, proved, ["subroot", "root"])


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and the siblings of its ancestors give."""
    levels = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(2))
    fold = F.aggregate(levels, digest, lambda acc, i: F.sha2(F.concat(F.try_element_at(steps, i), acc, F.try_element_at(steps, i + 1)), 256))
    return F.when(F.size(steps) == 0, digest).otherwise(fold)


def documents_manifest(docs: DataFrame, tampered: Column, band: int = BAND) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    Where ``tampered``, the leaf that is folded is that of a text without its \\n characters; siblings and all
    other columns are those of the original. Documents of one source ascend by doc_id, null first, equal ones by
    leaf. Other columns than doc_id, source, lang, n_chars and text are not read.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    bare = leaf_digest(*fields, F.translate("text", "\n", ""))
    leaves = docs.select("doc_id", "source", leaf_digest(*fields, F.col("text")).alias("digest"), F.when(tampered, bare).alias("bare"))
    leaves = materialize(leaves, "digests")
    out = manifest(leaves, ["source"], ["doc_id", "digest"], band)
    root = folded(F.coalesce("bare", "digest"), F.col("steps"))
    out = out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.array_join("steps", ""), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The manifest by SQL: one level after another, siblings by position, proofs put together upwards.
SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
docs AS (
  SELECT row_number() OVER () AS id, doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text, replace(text, chr(10), '') AS bare,
    xor(list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: x <> ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 AS tampered
  FROM documents, crc_table),
leaves AS (
  SELECT id, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN tampered THEN sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS first
  FROM docs),
nodes AS (
  SELECT source, 0 AS level, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, leaf AS digest, count(*) OVER (PARTITION BY source) AS size FROM leaves
  UNION ALL
  SELECT source, level + 1, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(size) + 2) // 3 FROM nodes WHERE size > 1 GROUP BY source, level, rank // 3),
subroots AS (SELECT source, digest AS subroot FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, subroot AS digest, count(*) OVER () AS size FROM subroots
  UNION ALL
  SELECT level + 1, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), (any_value(size) + 2) // 3 FROM tops WHERE size > 1 GROUP BY level, rank // 3),
sides AS (
  SELECT a.source, a.level, a.rank, coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank < a.rank), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank > a.rank), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.rank // 3 = b.rank // 3 WHERE a.size > 1 GROUP BY ALL),
top_sides AS (
  SELECT a.level, a.rank, coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank < a.rank), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (WHERE b.rank > a.rank), '') AS r
  FROM tops a JOIN tops b ON a.level = b.level AND a.rank // 3 = b.rank // 3 WHERE a.size > 1 GROUP BY ALL),
placed AS (SELECT id, doc_id, source, leaf, first, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM leaves),
sources AS (SELECT source, subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM subroots),
steps AS (
  SELECT p.id, s.level, s.l, s.r FROM placed p JOIN sides s ON p.source IS NOT DISTINCT FROM s.source AND p.rank // pow(3, s.level)::BIGINT = s.rank
  UNION ALL
  SELECT p.id, 1000 + t.level, t.l, t.r FROM placed p JOIN sources s ON p.source IS NOT DISTINCT FROM s.source JOIN top_sides t ON s.rank // pow(3, t.level)::BIGINT = t.rank),
proofs AS (SELECT id, string_agg(l || r, '' ORDER BY level) AS proof, list({'l': l, 'r': r} ORDER BY level) AS steps FROM steps GROUP BY id),
folded AS (
  SELECT p.*, s.subroot, (SELECT digest FROM tops WHERE size = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend({'l': first, 'r': ''}, coalesce(steps, [])), lambda a, b: {'l': sha256(b.l || a.l || b.r), 'r': ''}).l AS folded_root
  FROM placed p LEFT JOIN proofs USING (id) JOIN sources s ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
