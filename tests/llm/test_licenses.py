"""License scans against regular expressions and SQL, with odd rows and templates of all kinds of regions."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.test_dedup import DOCS
from tidemark.llm import licenses, queries

COLUMNS = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def plain(text):
    words = [w.decode() for w in licenses.WORD.findall((text or "").encode().lower())]
    at = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    joined = "".join(f" {w} " for w in words)
    found = {label for label, t in licenses.TEMPLATES if re.search(licenses.as_pattern(licenses.parsed(t)), joined)}
    base = {label for _, label in at}
    starts = [i for i, _ in at]
    score = 1.0 if found else 0.5 if base else 0.0
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(found | base)), score


def full(template):
    """A template's text with its regions in, and arbitrary words where any may stand."""
    text = re.sub(r"<<(?:begin|end)Optional>>", " ", template)
    return re.sub(r'<<var;match="([^"|]*)[^"]*">>', lambda m: "some holder" if m[1].startswith(".{") else m[1], text)


def bare(template):
    """A template's text without its optional regions."""
    while "<<beginOptional>>" in template:
        template = re.sub(r"<<beginOptional>>(?:(?!<<beginOptional>>|<<endOptional>>).)*<<endOptional>>", " ", template, flags=re.S)
    return full(template)


def texts():
    out = ["Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "cc by nc cc by nc CC-BY-NC", "under the mit license", "UNDER THE\tMIT\n\nLICENSE", "under the mit licenses", None, "", "...", "K under THE mıt license", "İ apache license version 2"]
    out += [f(t) for _, t in licenses.TEMPLATES for f in (full, bare, lambda t: full(t).upper(), lambda t: full(t).rsplit(None, 1)[0], lambda t: full(t).replace(" the ", " a ", 1))]
    rng = random.Random(5)
    parts = [full(t) for _, t in licenses.TEMPLATES] + list(licenses.PHRASES) + ["ka lo mi"] * 6
    out += [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    known = sorted({w for _, t in licenses.TEMPLATES[-3:] for w in full(t).split()} | {w for p in licenses.PHRASES for w in p.split()})
    out += [" ".join(rng.choice(known) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return out + ["word " * 50000 + "under the mit license " + "the " * 50000]


def test_against_regular_expressions_and_sql(spark, tmp_path):
    rows = [(i, t, None, None, None) for i, t in enumerate(texts())] + [(None, "cc by nc", None, None, None), (3, "cc by nc", None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(7) for c in ("id", "n_words", "labels", "words")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = [tuple(r) for r in queries.op13_license_scan(spark, str(tmp_path)).select(*COLUMNS).collect()]
    got = sorted(out, key=str)
    assert got == sorted(((r[0], *plain(r[1])) for r in rows), key=str)
    assert {r[6] for r in got} >= {"mit", "apache-2", "cc-by-nc", "gpl,gpl-3", "isc", "mpl-2", ""}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({licenses.sql()})").fetchall(), key=str) == got


TEMPLATE = 'a <<beginOptional>>b <<beginOptional>>c<<endOptional>> <<endOptional>> <<var;match="d|e f|.{2,3}">> g <<beginOptional>>h<<endOptional>>'


@pytest.mark.parametrize("most", [3, 20_000])
def test_regions_on_all_short_texts(most, monkeypatch):
    monkeypatch.setattr(licenses, "MOST_SETS", most)
    scanner = licenses.Scanner({"g a": "ga"}, [("t", TEMPLATE)])
    pattern = re.compile(licenses.as_pattern(licenses.parsed(TEMPLATE)) + "$")
    rng = random.Random(1)
    for _ in range(3000):
        words = [rng.choice("abcdefghx").encode() for _ in range(rng.randint(0, 12))]
        want = []
        for end in range(len(words)):
            if end and words[end - 1 : end + 1] == [b"g", b"a"]:
                want.append((0, end - 1, end))
            starts = [i for i in range(end + 1) if pattern.match("".join(f" {w.decode()} " for w in words[i : end + 1]))]
            if starts:
                want.append((1, min(starts), end))
        assert sorted(scanner.places(words)) == sorted(want)


def test_templates_that_are_wrong():
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>", '<<var;match=".{0,3}">>'):
        with pytest.raises(ValueError, match="region|mandatory"):
            licenses.Scanner({}, [("bad", bad)])


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], DOCS)).collect() == []
