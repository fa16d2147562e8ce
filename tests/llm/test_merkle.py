"""The Merkle manifest against plain Python and SQL, with odd rows, several bands and many sources."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import DOCS
from tidemark.llm import merkle, queries
from tidemark.llm.common import fold

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def code(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return sha("".join(map(code, (doc_id, source, lang, n_chars, text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        run = i // 3 * 3
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        i //= 3
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r, r[1]) for r in groups[s]]) for s in sources}
    over = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(groups[s]):
            steps = path(trees[s], i) + path(over, k)
            even = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 2 == 0
            folded = leaf(r, r[1].replace("\n", "") if even and r[1] is not None else r[1])
            for left, right in steps:
                folded = sha(left + folded + right)
            root = over[-1][0]
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, sha("".join(a + b for a, b in steps)), folded, folded == root))
    return sorted(out, key=str)


def result(spark, rows, tmp_path, extra=()):
    spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in extra}).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, str(tmp_path)).select(*COLUMNS).collect()), key=str)


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    return [(i * 7 - 100, rng.choice(["a\nb", "c\n\nd " * 3, "e", ""]) + str(i), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 3, 12])) for i in range(n)]


def odd():
    rows = rows_of(2, 30, ["x", None, "é", "Z", "é-2"])
    rows += [(5, None, None, None, None), (None, "a\nb", "en", "x", 3), (None, None, "en", "x", 3), (None, "", "en", "only", 3)]
    rows += [(9, "same\n", "en", "x", 5)] * 3 + [(9, "other", "en", "x", 5), (11, "y" * 200000 + "\n", "en", "", 200001), (1 << 60, "far", "en", "x", 3)]
    return rows


def test_against_plain_python_and_sql(spark, tmp_path):
    rows = odd()
    got = result(spark, rows, tmp_path, extra=("rank", "size", "digest", "steps", "root", "lo"))
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({merkle.SQL})").fetchall(), key=str) == got


@pytest.mark.parametrize("band", [1, 2])
def test_many_bands(spark, band):
    rows = rows_of(3, 400, ["hot"] * 30 + [f"s{i}" for i in range(12)] + [None])
    out = merkle.documents_manifest(spark.createDataFrame(rows, DOCS).repartition(5), fold(F.col("doc_id"), 2) == 0, band)
    assert sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, tmp_path, n):
    rows = rows_of(4, n, ["x"])
    got = result(spark, rows, tmp_path)
    assert got == plain(rows) and len(got) == n


def test_runs_of_three():
    for size in (1, 2, 3, 4, 9, 10, 27, 28):
        digests = [sha(str(i)) for i in range(size)]
        want, block = levels(digests), merkle.Block(digests, merkle.height(size))
        assert block.top() == want[-1][0] and merkle.height(size) == len(want) - 1
        assert all(block.siblings(i) == [s for pair in path(want, i) for s in pair] for i in range(size))
