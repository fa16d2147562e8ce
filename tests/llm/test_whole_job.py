"""Operators do the whole job where their inputs outgrow a filter, a list or a band."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import DOCS, brute_components
from tidemark.llm import lm, nndescent
from tidemark.llm.common import fold


def test_exact_columns_when_words_outgrow_the_filter(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 900}" for _ in range(20)) + f" only{i}") for i in range(200)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = [w for t in train for w in [*t.split(), None]]
    counts = {w: tokens.count(w) for w in set(tokens)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score(df, fold(F.col("doc_id"), 7) != 2, max_bits=1 << 10, common_words=4).collect()
    known = {r.id: r.n_known for r in got}
    assert known == {i: sum(w in counts for w in [*t.split(), None]) for i, t in rows}
    floor = math.log10(len(tokens) + len(counts) + 1)
    for r in got:
        own = [*dict(rows)[r.id].split(), None]
        assert r.base_score == pytest.approx(sum(math.log10(counts.get(w, 0) + 1) - floor for w in own))


def test_dense_groups_that_link_one_another(spark):
    # cosines of about 0.97 within each group, 0.91 between neighbouring ones
    rng = np.random.default_rng(8)
    axes = np.linalg.qr(rng.standard_normal((64, 5)))[0].T
    centres = [axes[0], 0.94 * axes[0] + np.sqrt(1 - 0.94**2) * axes[1], axes[2], 0.94 * axes[2] + np.sqrt(1 - 0.94**2) * axes[3], axes[4]]
    m = np.concatenate([c + rng.standard_normal((300, 64)) * np.sqrt(0.03 / 64) for c in centres] + [rng.standard_normal((200, 64))]).astype(np.float32)
    ids = list(range(len(m)))
    got = nndescent.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<float>")).collect()
    m = m.astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.9
    np.fill_diagonal(linked, False)
    assert linked[:300, 300:600].mean() > 0.5
    parts = brute_components(ids, zip(*np.nonzero(linked), strict=True))
    assert {parts[0], parts[300], parts[600], parts[900], parts[1200]} == {0, 600, 1200}
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (linked[i].sum(), parts[i]) for i in ids}


def test_pipeline_drops_near_copies_of_similarity_0_8(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((i, " ".join(words)))
        for k in range(1, 4):  # one word changed, then two, then six
            changed = list(words)
            for at in rng.sample(range(120), (1, 2, 6)[k - 1]):
                changed[at] = "changed"
            rows.append((100 * k + i, " ".join(changed)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "ONE  two")]

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[j : j + 5]) for j in range(max(len(words) - 4, 1))} if words else set()

    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    linked = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    parts = brute_components(ids, linked)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert kept == set(parts.values()) and 60 <= len(kept) < 200


def test_pairs_seen_once_are_in_the_filter(spark):
    text = " ".join(f"v{i}" for i in range(200))
    model, _ = lm.train(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    tokens, row = lm._tokens(np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)]))
    assert (model.counts(lm._pair_keys(lm._histories(tokens, row), tokens)) >= 1).all()


def test_vectors_of_each_length_are_compared(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [2.0, 4.1]), (4, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [0.0, 1.0, 0.1]), (7, [5.0]), (8, [0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("component_id", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(df).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (1, 5, True), 6: (1, 5, False), 7: (0, 7, True), 8: (0, 8, True)}
