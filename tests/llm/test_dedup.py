"""SimHash groups and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import repeats, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(shingles))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        if i > 4 and rng.random() < 0.5:
            base = out[rng.randrange(len(out))].split(" ")
            if len(base) > 3:
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 40, 200, 400]))))
    return out


def test_simhash_groups(spark):
    rows = list(enumerate(texts(1, 150))) + [(900, None), (901, ""), (902, "One two"), (903, "ONE  TWO\n"), (902, "One two")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = {i: brute_fingerprint(t) for i, t in rows}
    assert len(got) == len(rows)
    assert {r["id"]: r["fingerprint"] % 2**64 for r in got} == prints
    ids = sorted(prints)
    linked = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    assert linked
    assert {r["id"]: r["component_id"] for r in got} == brute_components(ids, linked)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 5, 7])
def test_grid_join_loses_no_pair(spark, distance):
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    values = set(base.tolist())
    for x in base.tolist():
        for k in range(1, 9):
            values.add(int(x) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    values = sorted(values)
    rows = [(v - 2**64 if v >> 63 else v,) for v in values]
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in simhash.similar_fingerprints(spark.createDataFrame(rows, "fingerprint long"), distance).collect()}
    assert got == {frozenset((a, b)) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= distance}


def test_keep_one_of_each_group(spark):
    rows = [(5, "a b c d e", "en", "s", 9), (3, "A b c d e", "en", "s", 9), (3, "A b c d e", "en", "s", 9), (None, "x y", None, None, None), (8, "quite another text here", None, "s", 1)]
    out = simhash.keep_one_of_each_group(spark.createDataFrame(rows, DOCS))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect()) == [(False, 3), (False, 8), (True, 0)]


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def brute_repeats(rows, length):
    first, cover = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        data = (t or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if first.setdefault(s, (i, p)) != (i, p):
                gone[p : p + length] = True
        cover[i] = gone
    out = {}
    for i, t in rows:
        data, gone = (t or "").encode(), cover[i]
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_repeats_brute(spark, seed):
    rng = random.Random(seed)
    rows = list(enumerate(texts(seed + 10, 60)))
    passage = " ".join(rng.choices(["dàs", "pässage", "that", "recurs", "often"], k=40))
    for k in range(70, 100):
        t = " ".join(rng.choices(["q", "ww", "eee", "r1"], k=rng.randint(1, 60)))
        rows.append((k, t[: rng.randrange(len(t) + 1)] + passage[: rng.randrange(60, len(passage))] + t))
    rows += [(200, None), (201, ""), (202, "x" * 99), (203, "x" * 100), (204, "x" * 350), (205, "ab" * 300), (206, "abab" * 80), (207, "line of some forty bytes, more or less\n" * 30), (None, rows[3][1])]
    rng.shuffle(rows)
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    want = brute_repeats(rows, 100)
    assert {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()} == want


def test_repeats_across_slices(spark, monkeypatch):
    # a text cut in many slices gives what it gives whole
    rng = np.random.default_rng(3)
    part = rng.integers(97, 123, 5000, dtype=np.uint8).tobytes().decode()
    rows = [(1, part + "-" + part[1000:3000]), (2, part[2500:] + "+" + part[:700]), (3, "é" * 400 + part[100:900])]
    want = brute_repeats(rows, 100)
    import tidemark.llm.repeats as module

    data = np.frombuffer(rows[0][1].encode(), dtype=np.uint8)
    whole = module.Runs(data, np.array([0, len(data)]), 100, 24)
    assert whole.count.sum() == len(data) - 99
    got = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["id"]: r[1:] for r in got.collect()} == want


def test_drop_repeats_keeps_characters_whole(spark):
    text = "é" * 200
    rows = [(1, text, "fr", "s", 200), (2, "a" + text + "b", "fr", "s", 202), (3, None, "fr", "s", 0), (4, text, "fr", "s", 200)]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in repeats.drop_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    assert 4 not in out and 3 not in out
    assert out[2] == ("ab", 2)


def test_repeats_empty_and_repeated_rows(spark):
    assert repeats.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "z1y2" * 20 + "w" * 30)] * 3
    out = repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1))).collect()
    assert len(out) == 3
