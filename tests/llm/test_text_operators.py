"""Fingerprints, token counts, packing and mixing against brute force, round trips and SQL."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import DOCS, texts
from tidemark.llm import cws, mixing, packing, tokencount

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def edited(rows):
    order = sorted(rows)
    out = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        q = len(t) // 4
        out[i] = t[: len(t) - q] + n[:q]
    return out


def jaccard(a, b):
    x, y = (collections.Counter(w for w in t.split(" ") if w) for t in (a, b))
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / max(1, sum(max(x[k], y[k]) for k in keys))


def test_fingerprints(spark):
    rows = list(enumerate(texts(5, 80)))
    rows += [(100, "x"), (101, "x"), (102, " "), (103, ""), (104, "nowhitespace" * 2000)]
    rows = [(i, t) for i, t in rows]
    df = frame(spark, [(i, t, None, None, None) for i, t in rows])
    got = {r.doc_id: r for r in cws.fingerprints(df, samples=32).collect()}
    want, text = edited(rows), dict(rows)
    assert set(got) == set(text)
    error, after = [], dict(zip(sorted(text), sorted(text)[1:] + sorted(text)[:1], strict=True))
    for i, r in got.items():
        assert r.n_chars == len(text[i])
        assert r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert (text[i] == want[i]) <= (r.fingerprint == r.edited_fingerprint)
        error.append(r.near_edited - jaccard(text[i], want[i]) if text[i].split() and want[i].split() else 0)
        n = after[i]
        shared = sum(r.fingerprint[k : k + 6] == got[n].fingerprint[k : k + 6] for k in range(0, 192, 6)) / 32
        assert r.near_next == shared
    assert got[100].fingerprint == got[101].fingerprint != got[104].fingerprint
    assert got[102].fingerprint == got[103].fingerprint
    assert abs(np.mean(error)) < 0.03 and np.max(np.abs(error)) < 0.35


def test_fingerprints_null_repeated_and_single(spark):
    rows = [(None, "a b", None, None, None), (3, None, None, None, None), (3, None, None, None, None), (4, "c d e f", None, None, 1)]
    got = cws.fingerprints(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_chars) for r in got) == [(False, 3, 0), (False, 3, 0), (False, 4, 7), (True, 0, 3)]
    assert next(r for r in got if r.doc_id == 4).edited_sha256 == hashlib.sha256(b"c d e a").hexdigest()
    one = cws.fingerprints(frame(spark, [(7, "abcdefgh", None, None, None)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1
    assert cws.fingerprints(frame(spark, [])).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    rng = random.Random(2)
    a, b = {k: rng.randint(1, 9) for k in range(40)}, {k: rng.randint(1, 9) for k in range(15, 60)}
    rows = [("a", k, float(v)) for k, v in a.items()] + [("b", k, float(v)) for k, v in b.items()]
    df = spark.createDataFrame(rows, "id string, term long, weight double")
    x, y = (list(r)[1:] for r in sorted(cws.signatures(df, ["id"], 256).collect()))
    keys = set(a) | set(b)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    assert abs(np.mean([p & cws.NOTHING == q & cws.NOTHING for p, q in zip(x, y, strict=True)]) - want) < 0.1


def brute_tokens(text, scores, byte_score):
    total = 0
    for word in text.encode().split():
        s = tokencount.MARK + word.decode()
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(s)
        for i in range(1, len(s) + 1):
            options = [(best[j][0] + scores[s[j:i]], -best[j][1] + -1) for j in range(i) if s[j:i] in scores]
            if s[i - 1] not in scores:
                n = len(s[i - 1].encode())
                options.append((best[i - 1][0] + n * byte_score, -best[i - 1][1] - n))
            top = max(options)
            best[i] = (top[0], -top[1])
        total += best[-1][1]
    return total


def test_token_counts(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    scores, byte_score = tokencount.unigram_scores(path)
    assert abs(sum(map(math.exp, scores.values())) - 1) < 1e-9
    rows = [(1, "The quick brown fox thinks thinking thoughts"), (2, "日本語 ☃☃ naïve\tx\n"), (3, None), (4, ""), (5, "z" * 400), (6, "the the the"), (None, "a b"), (6, "the the the")]
    got = [tuple(r) for r in tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(9)), path).collect()]
    want = [(i, len((t or "").split()), brute_tokens(t or "", scores, byte_score)) for i, t in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    trie = tokencount.CountingTrie(scores, byte_score)
    monkeypatch.setattr(tokencount, "MOST_NODES", 20)
    for w in "thinking think thinker thinks other others".split():
        assert trie.count(w) == brute_tokens(w, scores, byte_score)
    assert tokencount.token_counts(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def check_packed(rows, docs, width):
    """All ids of all documents once, windows without gaps or overlaps; gives the share of padding."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in docs.items()}
    seen = collections.defaultdict(list)
    windows = collections.defaultdict(list)
    for r in rows:
        part = np.array(ids[r["id"]][r["start"] : r["start"] + r["length"]], dtype="<u4")
        assert len(part) == r["length"] > 0 and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["id"]])
        seen[r["id"]].append((r["start"], r["length"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, x in ids.items():
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == len(x)
    pad = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= width
        pad += 0 if at & (at - 1) == 0 else width - at
    return pad / sum(map(len, ids.values()))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_packing(spark, parts):
    docs = dict(enumerate(texts(8, 120)))
    docs |= {900: None, 901: "", 902: "Ünïcode — ☃ 日本 <|endoftext|> \x1c \x85 end", 903: "word " * 9000}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(parts)
    out = packing.pack(df, TOKENIZER, RANKS).collect()
    assert check_packed([r.asDict() for r in out], docs, 2048) < 0.02


def test_packing_ids_and_empty(spark):
    df = spark.createDataFrame([(None, "one two"), (5, "three")], "doc_id long, text string")
    out = packing.pack(df, TOKENIZER, None, with_ids=True).collect()
    assert {r["id"] for r in out} == {None, 5} and all(len(r["ids"]) == 4 * r["length"] for r in out)
    assert packing.pack(df.limit(0), TOKENIZER, RANKS).count() == 0


def mix_rows(seed):
    rng = random.Random(seed)
    return [(i, t, "en", rng.choice(["a", "a", "a", "a", "b", "c", "é", None, "tiny"] if i % 40 else ["z"]), len(t)) for i, t in enumerate(texts(seed, 400))]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_equals_sql(spark, seed, tmp_path):
    rows = mix_rows(seed) + [(9000, None, None, None, None), (9001, "", None, "a", 0)]
    df = frame(spark, rows).repartition(7)
    got = mixing.taken_words(df).toPandas()
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841
    want = duckdb.sql(mixing.SQL).df()
    columns = sorted(got.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    assert (got["taken"] <= 3 * got["size"]).all() and got["size"].sum() > 1000
    by = got.groupby(["source_size", "target"])["taken"].sum().reset_index()
    assert ((by["taken"] - by["target"]).abs() <= 16 * 25).all()
    assert (by["target"] <= 3 * by["source_size"]).all()


def test_targets_are_reshared(spark):
    sizes = [("a", 1000), ("b", 10), (None, 100), ("c", 5)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, size long")).collect()}
    want, weights = {"b": 30.0, "c": 15.0}, {"a": 1, None: 1}  # a 1, b 2, c 3, null 1
    rest = 1115 - 45
    assert got == want | {None: 300.0, "a": rest - 300.0} and weights


def test_apportion_is_sainte_lague(spark):
    rng = random.Random(4)
    rows = [(g, i, rng.choice([0, 1, 5, 300, rng.randint(1, 10**6)]), seats) for g, seats in enumerate([0, 1, 7, 1000, 123456]) for i in range(30)]
    got = mixing.apportion(spark.createDataFrame(rows, "g int, i int, votes long, seats long"), ["g"], "votes", "seats", ["i"], "quota").collect()
    for g, seats in enumerate([0, 1, 7, 1000]):
        votes = {r.i: r.votes for r in got if r.g == g}
        best = sorted(((-v / (2 * k + 1), i, k) for i, v in votes.items() if v for k in range(seats)))[:seats]
        assert {r.i: r.quota for r in got if r.g == g} == {i: 0 for i in votes} | collections.Counter(i for _, i, _ in best)
    assert sum(r.quota for r in got if r.g == 4) == 123456


def test_mixed_documents(spark):
    rows = mix_rows(3)
    out = mixing.mixed_documents(frame(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    taken = {r.doc_id: r.taken for r in mixing.taken_words(frame(spark, rows)).collect()}
    got = collections.Counter()
    text = {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert text[r.doc_id].startswith(r.text) and len(r.text) == r.n_chars
        got[r.doc_id] += len(r.text.split())
    assert got == collections.Counter({k: v for k, v in taken.items() if v})
    assert mixing.mixed_documents(frame(spark, [])).count() == 0
    lead = mixing.mixed_documents(frame(spark, [(1, "  a b", "en", None, 5), (2, " c\td e f g h i", "en", "x", 9)])).collect()
    assert all(r.text.startswith(" ") for r in lead)
