"""Components, embeddings, language model, language ID, toxicity and the pipeline."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import DOCS, brute_components
from tidemark.llm import bloom, langid, lm, nndescent, toxicity
from tidemark.llm.common import fold
from tidemark.llm.components import connected_components


@pytest.mark.parametrize("kind", ["path", "dense", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(6)
    edges = {
        "path": [(i, i + 1) for i in range(40)],
        "dense": [(a, b) for a in range(25) for b in range(a)] + [(24, 90), (90, 91), (70, 71)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "empty": [],
    }[kind]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == brute_components({x for e in edges for x in e}, edges)


def test_bloom_has_no_false_negative(spark):
    keys = spark.range(20000).select(F.xxhash64("id").alias("key"))
    f = bloom.plain(keys, bloom.size_for(20000))
    own = np.array([r.key for r in keys.collect()], dtype=np.int64).view(np.uint64)
    assert f.contains(own).all()
    other = np.random.default_rng(1).integers(0, 2**63, 20000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.02


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 32))
    near = np.repeat(x[:6], 30, axis=0) + rng.standard_normal((180, 32)) * 0.22
    vectors = np.concatenate([x, near]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900 + i, vectors[3].tolist()) for i in range(4)]
    odd = [(1000, None), (1001, [0.0] * 32), (1002, [float("nan")] + [1.0] * 31), (1003, [None] + [1.0] * 31), (1004, [1.0, 2.0]), (None, vectors[3].tolist())]
    got = nndescent.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")).collect()
    ids, m = [i for i, _ in rows], np.array([v for _, v in rows], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    linked = m @ m.T >= 0.9
    np.fill_diagonal(linked, False)
    want = dict(zip(ids, linked.sum(1).tolist(), strict=True))
    parts = brute_components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(linked), strict=True) if a < b])
    found = {r.vec_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert {i: found[i].n_links for i in ids} == want and max(want.values()) > nndescent.NEIGHBOURS
    assert {i: found[i].component_id for i in ids} == parts
    assert all(found[i].kept == (parts[i] == i) for i in ids)
    assert all(found[i].n_links == 0 and found[i].component_id == i for i, _ in odd)
    assert nndescent.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language_model(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(300):
        at, text = rng.randrange(50), []
        for _ in range(rng.randint(0, 60)):
            text.append(words[at])
            at = (at * 3 + 1) % 50 if rng.random() < 0.8 else rng.randrange(50)
        rows.append((i, " ".join(text) + (f" Only{i}" if i % 5 == 0 else "")))
    rows += [(400, None), (401, ""), (402, "neverseen W1"), (402, "neverseen W1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    when = fold(F.col("doc_id"), 7) != 2
    for common in (8, 1000):  # counts of few words at hand, the others joined; or all at hand
        got = lm.score(df, when, common_words=common).collect()
        train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
        tokens = [w for t in train for w in [*(t or "").lower().split(), None]]
        counts = {w: tokens.count(w) for w in set(tokens)}
        assert len(got) == len(rows)
        text = dict(rows)
        for r in got:
            own = [*(text[r["id"]] or "").lower().split(), None]
            assert r.held_out == (zlib.crc32(str(r["id"]).encode()) % 7 == 2)
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), len(tokens))
            assert r.base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (len(tokens) + len(counts) + 1)) for w in own))
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held) and all(r.score < 0 for r in got)


def test_bloom_model_probabilities_sum_to_about_one(spark):
    df = spark.createDataFrame([(i, "a b a c a b b c a d") for i in range(50)], "doc_id long, text string")
    model, _ = lm.train(df)
    tokens, _ = lm._tokens(np.frombuffer(b"a b c d", dtype=np.uint8), np.array([0, 7]))
    counts = model.counts(lm._word_keys(tokens))
    for h, c in zip(tokens[:-1], counts, strict=False):  # nothing follows the end
        before = np.full(len(tokens), h)
        p = model.log10(lm._pair_keys(before, tokens), counts, np.full(len(tokens), c), before)
        assert 0.7 < (10**p).sum() < 1.3


def language_rows():
    rng = random.Random(2)
    sounds = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "ei", "ung", "ä"], "cc": ["oix", "eau", "qué", "re"]}
    return [(i, " ".join("".join(rng.choices(sounds[c], k=rng.randint(1, 4))) for _ in range(rng.randint(3, 40))), c, "s", 1) for i in range(240) for c in [rng.choice("aabbcc"[:6]) * 2]]


def test_language_id(spark):
    rows = language_rows()
    odd = [(900, None, "aa", "s", 0), (901, "", None, "s", 0), (902, "12 34 .", "bb", "s", 0), (None, "ka lo mi", None, None, None)]
    df = spark.createDataFrame(rows + odd, DOCS)
    when = fold(F.col("doc_id"), 4) != 2
    got = {r.doc_id: r for r in langid.identify(df, langid.fit(df, when)).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert np.mean([got[x[0]].lang_pred == x[2] for x in held]) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[None].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    empty = df.limit(0)
    assert langid.identify(empty, langid.fit(empty, when)).count() == 0


def test_toxicity(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        text = rng.choices(words, k=rng.randint(5, 60))
        bad = i % 5 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["vilest", "odious", "grubby"]) + rng.choice(["", "", "ly", "ness"]) + rng.choice(["", ".", "!"]))
        rows.append((i, " ".join(text).capitalize()))
        if i % 3:
            labels.append((i, int(bad)))
    df = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "odious")], "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"), fold(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    flagged = {i for i, s in got.items() if s >= toxicity.THRESHOLD}
    bad = {i for i, _ in rows if i % 5 == 0}
    assert len(flagged & bad) > 0.95 * len(bad) and not (flagged & {i for i, _ in rows}) - bad
    assert got[5000] == got[5001] < 0.5 < got[None]
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"), fold(F.col("doc_id"), 3) != 1)
    assert toxicity.score(df, none).where("score > 0.5").count() == 0


def test_pipeline(spark, tmp_path):
    """Each stage keeps what it should of a small table, and the last one packs all of its ids."""
    rows = language_rows()
    rows += [(1000 + i, *rows[i][1:]) for i in range(20)] + [(2000, None, "aa", "s", 0), (2001, "!!", "aa", "s", 2)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        seen[name] = docs.toPandas()
        if name != "pack_windows":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert set(seen["language_id"]["doc_id"]) == {r[0] for r in rows} - {2000, 2001}
    assert not set(seen["near_dedup"]["doc_id"]) & set(range(1000, 1020))
    assert set(seen["cut_repeats"]["doc_id"]) <= set(seen["near_dedup"]["doc_id"])
    words = {n: seen[n]["text"].str.split().str.len().sum() for n in ("cut_repeats", "mix_sources")}
    assert abs(words["mix_sources"] - words["cut_repeats"]) < 600
    assert seen["pack_windows"]["length"].sum() == seen["pack_windows"].loc[seen["pack_windows"]["start"] == 0, "doc_tokens"].sum()
    assert corpus_pipeline.run(spark, path).count() > 0
