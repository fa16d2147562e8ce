"""Columns whose names clash with helpers or results, and many languages."""

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import DOCS
from tidemark.llm import langid, mixing


def test_every_language_is_learned(spark):
    rng = random.Random(3)
    rows = []
    for k in range(200):
        syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(4)]
        rows += [(100 * k + i, " ".join(rng.choices(syllables, k=12)), f"l{k:03d}", "s", 1) for i in range(6)]
    df = spark.createDataFrame(rows, DOCS)
    model = langid.fit(df, F.col("doc_id") % 100 < 4)
    assert len(model.languages) == 200 and len(model.marks) == 200
    got = langid.identify(df.where("doc_id % 100 >= 4"), model, carry=["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.9 * len(got)


def test_names_that_clash(spark):
    rows = [(i, " ".join(["ka lo mi", "sch ung ei"][i % 2].split() * (i % 9 + 1)), ["aa", "bb"][i % 2], "ab"[i % 3 // 2], 9) for i in range(90)]
    df = spark.createDataFrame(rows, DOCS)
    extra = df.withColumns({c: F.lit(777) for c in ("_words", "_size", "_shard", "_taken", "score", "lang_pred", "cell", "size")})
    out = mixing.mixed_documents(extra)
    assert out.columns == extra.columns
    assert {tuple(r[5:]) for r in out.collect()} == {(777,) * 8}
    assert sorted(r.text for r in out.collect()) == sorted(r.text for r in mixing.mixed_documents(df).collect())
    model = langid.fit(extra, F.lit(True))
    with pytest.raises(ValueError, match="carried"):
        langid.identify(extra, model, carry=extra.columns)
    told = langid.identify(extra, model, carry=extra.columns, names=("_tidemark_lang", "_tidemark_score"))
    assert told.where("_tidemark_lang = lang and score = 777").count() == 90
