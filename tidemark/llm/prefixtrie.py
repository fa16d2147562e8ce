"""The prefix trie of conversations, built from its deepest level upwards by truncation peeling."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, n_words, shape, shared_folder

#: A turn in a path: digest of role and text, words of the text.
TURN = "struct<digest: binary, words: bigint>"
#: A node with at least one in so many of all nodes as children is a hot parent; there are at most so many of them.
HOT = 1000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text, the former led by its length."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): the turns of each conversation in order, as TURN.

    Null role or text is empty. Turns are ordered by ``turn``, null first, equal ones by role and then by digest;
    repeated rows are turns of their own. Rows of a null conv_id belong to no conversation. Other columns are not
    read. A path holds about 60 bytes for each turn, never a text.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select("conv_id", F.struct("turn", role.alias("role"), turn_digest(role, text).alias("digest"), n_words(text).alias("words")).alias("t"))
    path = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t.digest.alias("digest"), t.words.alias("words")))
    return turns.groupBy("conv_id").agg(path.cast(f"array<{TURN}>").alias("path"))


def spliced(seqs: DataFrame, every: int, turns: Column, most: int) -> DataFrame:
    """Paths whose first ``turns`` turns (a number from 0 to ``most``) come from conversation c - c % every, the others from c.

    Fewer turns are taken where that conversation has fewer, none where it is absent. At most 2 * every - 1
    conversations take theirs from one, so no key of the join is hot.
    """
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("head_id"), F.slice("path", 1, most).alias("head"))
    joined = seqs.withColumn("h", turns).join(heads, F.col("conv_id") - F.col("conv_id") % every == F.col("head_id"), "left")
    head = F.slice(F.coalesce("head", F.array().cast(f"array<{TURN}>")), F.lit(1), F.col("h"))
    own = F.slice("path", F.col("h") + 1, F.size("path"))
    return joined.select("conv_id", F.concat(head, own).alias("path"))


def node_key(path: Column) -> Column:
    """SHA-256, in hex, of the digests of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda t: F.hex(t.digest)), ""), 256)


_RUN = "key string, least bigint, n_convs bigint, ids string"
_END = "key string, conv_id bigint, n_convs bigint, ends_sha256 string"


def _joined_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Conversations sorted by (key, conv_id): the ids of each key of a batch as one comma-joined text."""
    for batch in batches:
        if not len(batch):
            continue
        keys, ids = batch["key"].to_numpy(), batch["conv_id"].to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(starts[1:], len(keys))
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, ends, strict=True)]
        yield pd.DataFrame({"key": keys[starts], "least": ids[starts], "n_convs": ends - starts, "ids": texts})


def _hashed_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs sorted by (key, least): one row for each key, with the hash of its runs one after another."""
    key = least = digest = None
    n = 0
    for batch in batches:
        done = []
        for k, first, m, ids in batch[["key", "least", "n_convs", "ids"]].itertuples(index=False, name=None):
            if k != key:
                if key is not None:
                    done.append((key, least, n, digest.hexdigest()))
                key, least, n, digest = k, first, 0, hashlib.sha256()
            elif n:
                digest.update(b",")
            digest.update(ids.encode())
            n += m
        yield pd.DataFrame(done, columns=["key", "conv_id", "n_convs", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, least, n, digest.hexdigest())], columns=["key", "conv_id", "n_convs", "ends_sha256"])


def merged_ends(paths: DataFrame) -> DataFrame:
    """(path, conv_id, n_convs, ends_sha256) of each distinct whole path: equal conversations made one before the peeling.

    A SHA-256 goes over its bytes in order, so the ids of copies of one conversation end in one task; they come
    there as comma-joined texts, one for each batch of a range of (path, conv_id), and are hashed as they stream
    by: the task holds one batch, however many copies there are.
    """
    keyed = paths.select(node_key(F.col("path")).alias("key"), "conv_id")
    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = keyed.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = ranges.mapInPandas(_joined_runs, _RUN)
    ends = runs.repartition(n, "key").sortWithinPartitions("key", "least").mapInPandas(_hashed_runs, _END)
    return ends.join(paths.select("conv_id", "path"), "conv_id").select("path", "conv_id", "n_convs", "ends_sha256")


def with_shared(ended: DataFrame) -> DataFrame:
    """``ended`` with shared, the greatest depth to which a path runs together with another one.

    Prefixes are counted by 64-bit hashes; should two be equal by chance, a path counts as shared for longer than
    it is, which changes the work and no result.
    """
    hashes = F.aggregate("path", F.array(F.lit(0).cast("long")), lambda acc, t: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), t.digest))))
    prefixes = ended.select("conv_id", F.posexplode(hashes).alias("depth", "hash"))
    alone = prefixes.groupBy("hash", "depth").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
    first = alone.where("depth > 0").groupBy("conv_id").agg(F.min("depth").alias("first"))
    return ended.join(first, "conv_id", "left").select(*ended.columns, F.coalesce(F.col("first") - 1, F.size("path")).alias("shared"))


_SUMS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
_NODE = ("depth", "conv_id", *_SUMS, "ends_sha256", "digest", "key", "parent_key")


def tails(ended: DataFrame) -> DataFrame:
    """The nodes (_NODE) of each path beyond what it shares: no other conversation has them, so they are peeled off at once.

    ``key`` is null, as no other node asks for these; ``parent_key`` is set for the topmost of a path only.
    """
    n = F.size("path")
    at = ended.where(n > F.col("shared")).select("*", F.explode(F.sequence(F.col("shared") + 1, n)).alias("depth"))
    words = F.aggregate(F.slice("path", F.col("depth"), n), F.lit(0).cast("long"), lambda acc, t: acc + t.words)
    last = F.col("depth") == n
    return at.select(
        "depth", "conv_id", "n_convs", F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * words).alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(NO_ENDS).alias("ends_sha256"),
        F.element_at("path", F.col("depth")).digest.alias("digest"), F.lit(None).cast("string").alias("key"),
        F.when(F.col("depth") == F.col("shared") + 1, node_key(F.slice("path", 1, F.col("shared")))).alias("parent_key"),
    )


def peel(ended: DataFrame) -> DataFrame:
    """Every node (_NODE) of the trie of ``ended``, a table with the columns of with_shared().

    From the greatest depth to the root: the nodes of one level are the conversations that end there, merged with
    the nodes of the level below whose last turn is stripped. One grouping by the path that is left finds the
    nodes and sums up all that they report, so nothing is counted again. What a conversation shares with no other
    is stripped at once when it is met (tails), so there are as many passes as turns that two different
    conversations share, each over the nodes of two levels; each level is written to the shared folder before the
    next reads it. A node with very many children gets one partial row from each task.
    """
    spark = ended.sparkSession
    own = tails(ended)
    deepest = ended.agg(F.max("shared")).first()[0]
    none = F.lit(0).cast("long")
    ends = ended.where(F.size("path") == F.col("shared")).select("shared", "path", "conv_id", "n_convs", none.alias("n_children"), none.alias("n_leaves"), none.alias("saved_tokens"), "ends_sha256")
    words = F.aggregate(F.slice("path", F.col("shared") + 1, F.size("path")), none, lambda acc, t: acc + t.words)
    stripped = ended.where(F.size("path") > F.col("shared")).select("shared", F.slice("path", 1, F.col("shared")).alias("path"), "conv_id", "n_convs", (none + 1).alias("n_children"), (none + 1).alias("n_leaves"), ((F.col("n_convs") - 1) * words).alias("saved_tokens"), F.lit(None).cast("string").alias("ends_sha256"))
    met = ends.unionByName(stripped)
    columns = ["path", "conv_id", *_SUMS, "ends_sha256"]
    schema = shape(met.select(*columns))
    last = F.try_element_at("path", F.lit(-1))
    folder = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex[:12]}/nodes"
    alive = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = met.where(F.col("shared") == depth).select(*columns)
        if alive is not None:
            level = level.unionByName(alive.select(F.slice("path", 1, depth).alias("path"), "conv_id", "n_convs", (none + 1).alias("n_children"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256")))
        sums = level.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in _SUMS), F.max("ends_sha256").alias("ends_sha256"))
        sums = sums.withColumns({"n_leaves": F.greatest("n_leaves", none + 1), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.coalesce(last.words, none), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS))})
        sums.select(*columns).write.parquet(f"{folder}/level={depth}")
        alive = spark.read.schema(schema).parquet(f"{folder}/level={depth}")
    if alive is None:
        return own
    shared = spark.read.schema(schema).parquet(*[f"{folder}/level={d}" for d in range(deepest + 1)])
    parent = F.when(F.size("path") > 0, node_key(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))))
    shared = shared.select(F.size("path").alias("depth"), "conv_id", *_SUMS, "ends_sha256", last.digest.alias("digest"), node_key(F.col("path")).alias("key"), parent.alias("parent_key"))
    return own.unionByName(shared)


def with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id, the conv_id of the node without the last turn; null for the root.

    Within a tail that is the node's own. The others ask by key: parents of a thousandth of all nodes or more, a
    thousand at most, are broadcast, the rest joined, where no key has more rows than that.
    """
    least = max(1, -(-nodes.count() // HOT))
    parents = nodes.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found"), "n_children")
    hot = parents.where(F.col("n_children") >= least).drop("n_children")
    others = parents.where((F.col("n_children") > 0) & (F.col("n_children") < least)).drop("n_children")
    told = nodes.join(F.broadcast(hot), "parent_key", "left")
    known = told.where("found is not null or parent_key is null")
    rest = told.where("found is null and parent_key is not null").drop("found").join(others, "parent_key")
    parent = F.when(F.col("depth") > 0, F.coalesce("found", "conv_id"))
    return known.unionByName(rest).select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), *_SUMS, "ends_sha256", "digest")


def trie(paths: DataFrame) -> DataFrame:
    """Every node of the prefix trie of ``paths`` (conv_id unique, path as TURN), the root of depth 0 included.

    conv_id is the smallest member, parent_conv_id the parent's; n_convs the members, n_children the nodes one turn
    longer, n_leaves the childless nodes of the subtree, saved_tokens the sum over the subtree of the words of a
    node's last text times its members but one, ends_sha256 the hash of the ids of the conversations that end in
    the node, digest its last turn's. An empty table gives no node, not even a root.
    """
    ended = materialize(merged_ends(materialize(paths, "paths")), "ends")
    return with_parents(materialize(peel(materialize(with_shared(ended), "shared")), "trie"))


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with last_role and last_text, those of the turn that a node adds to its parent; null for the root."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.select(turn_digest(role, text).alias("digest"), role.alias("last_role"), text.alias("last_text")).dropDuplicates(["digest"])
    return nodes.join(turns, "digest", "left")


#: The nodes by SQL: every prefix of every rebuilt conversation as a list of (role, text), grouped and summed up its ancestors.
SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
turns AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t, turn, coalesce(role, '') AS role,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, role, digest) AS path FROM turns GROUP BY conv_id),
split AS (
  SELECT conv_id, path, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM own, crc_table),
rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.path, [])[1:s.h], s.path[s.h + 1:]) AS path
  FROM split s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 20),
prefixes AS (SELECT conv_id, d AS depth, path[1:d] AS prefix, len(path) = d AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    (count(*) - 1) * coalesce(len(regexp_extract_all(prefix[-1].text, '[^\\x20\\x09-\\x0D]+')), 0) AS saved
  FROM prefixes GROUP BY prefix, depth),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (prefix)),
subtrees AS (
  SELECT prefix[1:a] AS prefix, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS a FROM counted) GROUP BY ALL)
SELECT c.conv_id, c.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
FROM counted c JOIN subtrees s USING (prefix) LEFT JOIN nodes p ON c.depth > 0 AND p.prefix = c.prefix[1:c.depth - 1]
"""
