"""Crowded cells of the SimHash grids: no link is lost, and near groups cost rows in proportion to their size."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import DOCS, brute_components
from tidemark.llm import shingles, simhash
from tidemark.llm.components import connected_components


def signed(values):
    return [(v - 2**64 if v >> 63 else v,) for v in values]


def ball(centre):
    """All numbers within two bits of ``centre``: any two differ in four at most."""
    bits = [1 << i for i in range(64)]
    return [centre, *(centre ^ b for b in bits), *(centre ^ b ^ c for b, c in itertools.combinations(bits, 2))]


def test_dense_group_gives_a_forest(spark):
    values = sorted({*ball(0x0123456789ABCDEF), *ball(0xFEDCBA9876543210)})
    links = simhash.similar_fingerprints(spark.createDataFrame(signed(values), "fingerprint long"))
    assert links.count() < 200 * len(values) < len(values) ** 2 / 20
    groups = connected_components(links).groupBy("component").count().collect()
    assert sorted(r["count"] for r in groups) == [2081, 2081]


@pytest.mark.parametrize("crowded", [16, 64])
def test_crowded_cells_are_split(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = np.random.default_rng(1)
    values = {0}
    for _ in range(400):  # few bits set, so that cells are crowded, and many pairs beyond four bits
        values.add(sum(1 << int(b) for b in rng.choice(24, rng.integers(1, 9), replace=False)))
    values = sorted(values)
    links = simhash.similar_fingerprints(spark.createDataFrame(signed(values), "fingerprint long"), 2)
    pairs = [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2]
    assert all((r.a ^ r.b).bit_count() <= 2 for r in links.collect())
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == brute_components({x for p in pairs for x in p}, pairs)


@pytest.mark.parametrize("n", [10**3, 10**9])
def test_grids_suit_the_table(n):
    grids = simhash.exact_grids(4, n)
    assert sum(g.radius + 1 for g in grids) == 5 and sum(len(g.segments) for g in grids) == 32
    assert len(grids) == (3 if n < 10**6 else 2)
    wide = shingles._plan(n, 0.8)
    assert len(wide) == (9 if n < 10**6 else 26)


@pytest.mark.parametrize("large", [False, True])
def test_near_texts_by_either_plan(spark, monkeypatch, large):
    if large:
        plan = shingles._plan
        monkeypatch.setattr(shingles, "_plan", lambda n, similarity: plan(10**9, similarity))
    rng = random.Random(12)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 150, 600]))]
        for k in range(6):
            text = list(base)
            for at in rng.sample(range(len(base)), k * len(base) // 100):
                text[at] = f"other{k}"
            rows.append((10 * i + k, " ".join(text)))
    rows += [(1000, None), (1001, " \n"), (1002, "one"), (None, rows[7][1]), (1003, "x " * 70000)]

    def sets(text):
        w = (text or "").lower().split()
        return {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set()

    have = [sets(t) for _, t in rows]
    linked = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if have[a] == have[b] or have[a] and have[b] and len(have[a] & have[b]) >= 0.8 * len(have[a] | have[b])]
    parts = brute_components(range(len(rows)), linked)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).withColumn("fingerprint", F.lit("clash")).withColumn("words", F.lit(3))
    got = {(r.id, r.text_key): r.component_id for r in shingles.near_duplicates(df).collect()}
    keys = [(r.doc_id, r.k) for r in df.select("doc_id", simhash.text_key(F.col("text")).alias("k")).collect()]
    same = sum((got[keys[a]] == got[keys[b]]) == (parts[a] == parts[b]) for a, b in itertools.combinations(range(len(rows)), 2) if None not in (rows[a][0], rows[b][0]))
    pairs = (len(rows) - 1) * (len(rows) - 2) // 2
    assert same >= pairs - 20  # a pair at 0.8 exactly may be missed
    wrong = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if None not in (rows[a][0], rows[b][0]) and got[keys[a]] == got[keys[b]] and parts[a] != parts[b]]
    assert not wrong


def test_no_documents(spark):
    assert shingles.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
