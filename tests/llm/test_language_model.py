"""Scores of the language model against a plain Python version, with filters of any size."""

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm
from tidemark.llm.common import fold
from tidemark.llm.textarrays import chunks


def quantised(count):
    level = 1 + math.floor(math.log(count) / math.log(lm.LOG_BASE) + 1e-9)
    return max((lm.LOG_BASE ** (level - 1) + lm.LOG_BASE**level - 1) / 2, 1.0)


def brute_scores(rows, train):
    """log10 probabilities of texts by Witten-Bell smoothing on quantised counts."""
    single, pairs, followers = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for t in train:
        tokens = [*(t or "").lower().split(), "</s>"]
        single.update(tokens)
        for h, w in zip(["<s>", *tokens], tokens, strict=False):
            pairs[h, w] += 1
            followers[h].add(w)
    after = collections.Counter()
    for (h, _), n in pairs.items():
        after[h] += n
    total, out = sum(single.values()), {}
    for i, t in rows:
        score, h = 0.0, "<s>"
        for w in [*(t or "").lower().split(), "</s>"]:
            own = ((quantised(single[w]) if single[w] else 0) + 1) / (total + len(single) + 1)
            history = quantised(single[h]) if h != "<s>" and single[h] else 0
            ratio = len(followers[h]) / after[h] if after[h] else 1.0
            if history:
                both = min(quantised(pairs[h, w]) if pairs[h, w] else 0, history)
                own = (both + history * ratio * own) / (history + history * ratio)
            score += math.log10(own)
            h = w
        out[i] = score
    return out


def chains(seed, n, vocabulary=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at, text = rng.randrange(vocabulary), []
        for _ in range(rng.randint(0, 40)):
            text.append(f"w{at}")
            at = (at * 3 + 1) % vocabulary if rng.random() < 0.8 else rng.randrange(vocabulary)
        rows.append((i, " ".join(text) + (f" Only{i} only{i + 1}" if i % 9 == 0 else "")))
    return [*rows, (n, None), (n + 1, ""), (n + 2, "neverseen W1 again"), (None, "w1 w4"), (n + 3, "w1 " * 30000)]


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 18, 1 << 4])
def test_scores_equal_plain_python_at_any_filter_size(spark, monkeypatch, max_bits):
    # so many bits for each entry that no probe is wrong; room for all blocks, for some, for none
    monkeypatch.setattr(lm, "BITS_PER_ENTRY", 400)
    rows = chains(3, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("score", F.lit(1.0))
    got = {r.id: r for r in lm.score(df, fold(F.col("doc_id"), 7) != 2, max_bits=max_bits, common_words=8).collect()}
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    want = brute_scores(rows, train)
    assert len(got) == len(rows)
    for i, x in want.items():
        assert got[i].score == pytest.approx(x, rel=1e-5), i


def test_blocks_that_are_not_broadcast_hold_the_rest(spark):
    df = spark.createDataFrame([(i, t) for i, t in chains(5, 80)], "doc_id long, text string")
    full, words = lm.train(df)
    model, _, lacking = lm._trained(df, "text", max_bits=64 * len(full.blocks.data) * 3 // 4)
    rest = lacking.collect()
    assert model.pairs_open and not model.words_open and rest
    other = lm.Blocks(np.array([r.place for r in rest]), [np.frombuffer(r.bits, dtype="<u8") for r in rest], model.blocks.segments)
    counts = {r.key: r.n for r in words.collect()}
    keys = np.array(sorted(counts), dtype=np.int64).view(np.uint64)
    assert (model.counts(keys) >= lm._middle(lm._level(np.array([counts[k] for k in sorted(counts)]), lm.LOG_BASE), lm.LOG_BASE)).all()
    tokens, row = lm._tokens(*next(iter(chunks(pa.array([t for _, t in chains(5, 80)]))))[1:])
    pairs = np.unique(lm._pair_keys(lm._histories(tokens, row), tokens))
    levels = np.maximum(model.blocks.levels(pairs), other.levels(pairs))
    assert (levels >= full.blocks.levels(pairs)).mean() > 0.98 and (levels >= 1).all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(df, fold(F.col("doc_id"), 7) != 2).count() == 0
    none = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lm.score(none, F.lit(False)).first().score == pytest.approx(0.0)
