"""Kernels over texts hold few arrays at a time: Python workers share an executor's memory with its JVM."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_dedup import DOCS
from tidemark.llm import bloom, repeats, shingles


@pytest.fixture(scope="module")
def batch():
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(600)) for _ in range(1000)]
    return pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(range(1000)), pa.array(texts)], names=["id", "text_key", "text"])


def peak_mb(run) -> float:
    """The most MB that numpy and Python hold over a second call, when what is kept for good is there."""
    run()
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def kernel_of(spark, monkeypatch, call):
    """The function that ``call`` gives to mapInArrow."""
    df = spark.createDataFrame([], DOCS).selectExpr("doc_id id", "doc_id text_key", "text")
    kernels = []
    real = type(df).mapInArrow
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, run, schema, *more: kernels.append(run) or real(self, run, schema, *more))
        call(df)
    return kernels[-1]


def test_fingerprints_of_shingle_sets(spark, monkeypatch, batch):
    run = kernel_of(spark, monkeypatch, lambda df: shingles._prints(df, 5, 3))
    assert sum(len(b) for b in run(iter([batch]))) == 1000
    assert peak_mb(lambda: [None for _ in run(iter([batch]))]) < 24


def test_whole_shingle_sets(spark, monkeypatch, batch):
    full = bloom.Bloom(np.full(bloom.SEGMENT_BITS // 64, ~np.uint64(0)), bloom.SEGMENT_BITS, 5)
    monkeypatch.setattr(bloom, "plain", lambda keys, bits: full)
    run = kernel_of(spark, monkeypatch, lambda df: shingles._whole_sets(df, df.selectExpr("id AS node"), 5))
    assert sum(len(b) for b in run(iter([batch]))) == 1000
    assert peak_mb(lambda: [None for _ in run(iter([batch]))]) < 24


def test_runs_of_repeats(batch):
    def run():
        for _, _, data, offsets in repeats._slices(batch.column("text"), 100):
            repeats.Runs(data, offsets, 100, 24)

    assert peak_mb(run) < 32
