"""Language ID against a plain kernel, landmarks and ridge: n-grams as Python sets, every kernel value by itself."""

import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.test_dedup import DOCS
from tidemark.llm import langid


def grams(text):
    """The n-grams of one to three letters of a text, a run of anything else counting as one blank."""
    symbols = []
    for b in text.encode().lower():
        letter = 97 <= b < 123 or b >= 128
        if letter or not symbols or symbols[-1] != 0:
            symbols.append(b if letter else 0)
    return {tuple(symbols[i : i + n]) for n in (1, 2, 3) for i in range(len(symbols) - n + 1)}


def plain(train, texts, landmarks, ridge):
    """Scores (texts x languages) of kernel ridge regression in the span of the landmarks."""
    languages = sorted({c for _, c in train})
    by = {c: [t for t, x in train if x == c] for c in languages}
    turns = [by[c][i] for i in range(max(map(len, by.values()))) for c in languages if i < len(by[c])]
    marks = [grams(t) for t in turns[:landmarks]]
    known = set().union(*marks)

    def kernel(a, b):
        a, b = a & known, b & known
        return len(a & b) / np.sqrt(max(len(a), 1) * max(len(b), 1))

    between = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(between)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])

    def features(ts):
        return np.hstack([np.array([[kernel(grams(t), m) for m in marks] for t in ts]) @ root, np.ones((len(ts), 1))])

    x, y = features([t for t, _ in train]), np.array([[c == d for d in languages] for _, c in train], dtype=float)
    w = 1 / y.sum(axis=0)[y.argmax(axis=1)]
    w *= len(w) / w.sum()
    return languages, features(texts) @ np.linalg.solve((x * w[:, None]).T @ x + ridge * np.eye(x.shape[1]), (x * w[:, None]).T @ y)


def corpus(seed, n):
    rng = random.Random(seed)
    syllables = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ei", "Ü"], "cc": ["que", "é", "oi", "lo"]}
    return [("".join(rng.choice(syllables[c]) + rng.choice(["", " ", ". ", "  7"]) for _ in range(rng.randint(3, 40))), c) for c in rng.choices(sorted(syllables), k=n)]


def test_scores_are_those_of_the_plain_kernel(spark):
    train, texts = corpus(1, 60), [t for t, _ in corpus(2, 50)] + ["K", "123 x", "ka lo" * 500]
    model = langid.Classifier([t.encode() for t, _ in train], [c for _, c in train], 12, 0.1)
    languages, want = plain(train, texts, 12, 0.1)
    assert model.languages == languages
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i, s in enumerate(want):
        assert abs(got[i].score - min(max(s.max(), 0), 1)) < 2e-4
        if np.sort(s)[-1] - np.sort(s)[-2] > 1e-3:
            assert got[i].lang_pred == languages[int(s.argmax())]


def test_ties_go_to_the_first_language(spark):
    train = [("ka lo mi", "bb"), ("ka lo mi", "aa"), ("ka lo mi", "aa"), ("ka lo mi", "bb")]
    model = langid.Classifier([t.encode() for t, _ in train], [c for _, c in train], 4, 0.1)
    df = spark.createDataFrame([(1, "ka lo mi", None, None, None), (1, "ka lo mi", None, None, None), (2, "zz", None, None, None)], DOCS)
    got = langid.identify(df, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:2]] == ["aa", "aa"] and got[0].score == got[1].score and abs(got[0].score - 0.5) < 0.02
    assert got[2].lang_pred in ("aa", "bb")


def test_fit_reads_only_training_rows(spark):
    rows = [(i, t, c, "s", 1) for i, (t, c) in enumerate(corpus(3, 80))]
    df = spark.createDataFrame([*rows, (900, "zz zz", "never", "s", 1)], DOCS)
    model = langid.fit(df, F.col("doc_id") < 60)
    assert model.languages == ["aa", "bb", "cc"]
