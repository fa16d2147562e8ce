"""The label model against a plain loop, scores from the words of a text one by one, and rows that are empty or repeat."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_dedup import DOCS
from tidemark.llm import toxicity


def plain(votes, gold, prior, rounds=15):
    """Expectation maximisation by loops: (posteriors, log weights)."""
    rows = [[*v, 0 if any(v) else 1] for v in votes]
    n, m = len(rows), len(rows[0])
    post = [prior if g < 0 else toxicity.LABEL_TRUST if g == 1 else 1 - toxicity.LABEL_TRUST for g in gold]
    share = [1.0] * m
    for k in range(rounds):
        a = [(sum(p * r[j] for p, r in zip(post, rows, strict=True)) + 0.5) / (sum(post) + 1) for j in range(m)]
        b = [(sum((1 - p) * r[j] for p, r in zip(post, rows, strict=True)) + 0.05) / (n - sum(post) + 1) for j in range(m)]
        if k in (rounds // 3, 2 * rounds // 3):
            left = [[r[j] - p * a[j] - (1 - p) * b[j] for j in range(m)] for p, r in zip(post, rows, strict=True)]
            size = [math.sqrt(max(sum(x[j] ** 2 for x in left), 1e-9)) for j in range(m)]
            for i in range(m - 1):
                related = [(sum(x[i] * x[j] for x in left) / (size[i] * size[j])) ** 2 for j in range(m)]
                share[i] = 1 / max(sum(c for c in related if c > 0.04), 1)
        fire = [math.log(a[j] / b[j]) * share[j] for j in range(m)]
        trust = math.log(toxicity.LABEL_TRUST / (1 - toxicity.LABEL_TRUST))
        for i, r in enumerate(rows):
            odds = sum(x * f for x, f in zip(r, fire, strict=True)) + math.log(prior / (1 - prior)) + (0 if gold[i] < 0 else trust if gold[i] == 1 else -trust)
            post[i] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return post, fire[:-1]


def test_label_model_is_the_plain_loop():
    rng = random.Random(1)
    toxic = [rng.random() < 0.3 for _ in range(100)]
    votes = [[int(rng.random() < (0.6 if t else 0.05)) for _ in range(5)] for t in toxic]
    votes = [[*v, v[0]] for v in votes]  # one voter repeats another, and shares its weight
    gold = [rng.choice([int(t), int(t), -1]) for t in toxic]
    post, fire = toxicity.label_model(np.array(votes, dtype=np.float64), np.array(gold), 0.3)
    want_post, want_fire = plain(votes, gold, 0.3)
    np.testing.assert_allclose(post, want_post, atol=1e-9)
    np.testing.assert_allclose(fire, want_fire, atol=1e-9)
    assert abs(fire[0] - fire[5]) < 1e-9 and fire[0] < 0.7 * max(fire[1:5])


def corpus(seed, n):
    rng = random.Random(seed)
    bad, fine = [f"bad{c}word" for c in "abcdefgh"], ["ka", "lo", "mi", "sonne", "Ünder"]
    out = []
    for i in range(n):
        toxic = i % 3 == 0
        out.append((i, " ".join(rng.choices(fine, k=rng.randint(3, 20)) + (rng.choices(bad, k=2) if toxic else [])) + rng.choice(["", "!", " 7"]), toxic))
    return out


def test_scores_come_from_the_words(spark):
    rows = corpus(2, 240)
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, int(x)) for i, _, x in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 4 > 0)
    assert len(model.voters)
    weight = dict(zip(model.voters.tolist(), model.weights.tolist(), strict=True))
    odd = [(900, None), (901, ""), (902, "BADAWORD badaword"), (902, "BADAWORD badaword"), (None, "badb"), (903, "x" * 100000 + " badcword")]
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumns({"score": F.lit(7), "row": F.lit(8)})
    got = toxicity.score(extra, model, carry=["doc_id", "text"]).collect()
    assert len(got) == len(rows) + len(odd)
    hashes = {}

    def features(text):
        for word in re.findall(rb"[a-z\x80-\xff]+", (text or "").encode().lower()):
            if word not in hashes:
                hashes[word] = set(toxicity._features(np.frombuffer(word, dtype=np.uint8), np.array([0, len(word)]))[0].tolist())
            yield from hashes[word]

    for r in got:
        total = model.bias + sum(weight[h] for h in set(features(r.text)) if h in weight)
        assert abs(r.score - 1 / (1 + math.exp(-max(-40, min(40, total))))) < 1e-9


def test_empty_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))).collect() == []
