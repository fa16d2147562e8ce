"""The prefix trie of conversations against plain Python and SQL, with odd rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefixtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, digest, text))
    convs = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    nodes = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in nodes) for p in below)
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if rebuilt[c] == path)
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def result(spark, rows, tmp_path, extra=()):
    df = spark.createDataFrame(rows, SCHEMA)
    df.withColumns({c: F.lit(7) for c in extra}).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_prefix_trie(spark, str(tmp_path)).select(*COLUMNS).collect()
    out = set(map(tuple, got))
    assert len(out) == len(got)
    return out


def some(seed, n, texts):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "assistant"]), " ".join(rng.choices("ab", k=rng.randint(1, texts)))) for c in range(n) for t in range(rng.randint(1, 5))]
    rng.shuffle(rows)
    return rows


def test_against_plain_python_and_sql(spark, tmp_path):
    rows = some(1, 120, 2)
    got = result(spark, rows, tmp_path)
    assert got == plain(rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert set(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefixtrie.SQL})").fetchall()) == got


def test_odd_rows(spark, tmp_path):
    rows = some(2, 50, 1)
    rows += [(1000, None, None, None), (1000, None, "user", None), (1000, 3, None, "x" * 100000), (1001, 1, "user", "a"), (1001, 1, "user", "a"), (1001, 1, "assistant", "b")]
    rows += [(None, 0, "user", "lost"), (-7, 0, "user", "a"), (1041, 0, "user", "a")]
    rows += [(2000 + i, 0, "user", "a") for i in range(300)] + [(3000, t, "user", str(t)) for t in range(40)]
    assert result(spark, rows, tmp_path, extra=("path", "_key", "depth", "key", "h")) == plain([r for r in rows])


def test_ids_of_copies_over_many_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        paths = spark.range(500).select((F.col("id") * 3 - 40).alias("conv_id"), F.when(F.col("id") % 5 > 0, F.array(F.struct(F.unhex(F.lit("ab")).alias("digest"), F.lit(2).cast("long").alias("words")))).otherwise(F.array().cast(f"array<{prefixtrie.TURN}>")).alias("path"))
        got = {r.conv_id: r for r in prefixtrie.merged_ends(paths).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = [[i * 3 - 40 for i in range(500) if (i % 5 > 0) == full] for full in (False, True)]
    assert len(got) == 2
    for ids in want:
        r = got[min(ids)]
        assert r.n_convs == len(ids) and r.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty_table_and_texts(spark, tmp_path):
    assert result(spark, [], tmp_path) == set()
    rows = [(1, 0, "user", "what"), (1, 1, "assistant", None), (2, 0, "user", "what"), (3, 0, None, "so")]
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = prefixtrie.with_turns(prefixtrie.trie(prefixtrie.sequences(df)), df)
    got = {(r.depth, r.conv_id, r.last_role, r.last_text, r.n_convs) for r in nodes.collect()}
    assert got == {(0, 1, None, None, 3), (1, 1, "user", "what", 2), (2, 1, "assistant", "", 1), (1, 3, "", "so", 1)}


@pytest.mark.parametrize("hot", [1, 1000])
def test_parents_with_and_without_broadcast(spark, tmp_path, hot, monkeypatch):
    monkeypatch.setattr(prefixtrie, "HOT", hot)
    rows = some(4, 60, 1)
    assert result(spark, rows, tmp_path) == plain(rows)
