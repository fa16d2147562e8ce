"""Kernels of the language model hold little at a time: a segment's keys, not those of a task, and small slices of text."""

import numpy as np
import pyarrow as pa

from tests.llm.test_worker_memory import batch, kernel_of, peak_mb  # noqa: F401  a fixture
from tidemark.llm import lm


def partials(segments, keys_each, times):
    """Rows as a task that counts gets them: segments one after another, the keys of each ``times`` times, in batches that cut them."""
    rng = np.random.default_rng(5)
    low = rng.integers(0, 1 << 40, (segments, keys_each), dtype=np.uint64)
    keys = np.sort(low | (np.arange(segments, dtype=np.uint64) << np.uint64(40))[:, None], axis=1)
    one = np.ones(keys_each, dtype=np.int32).tobytes()
    rows = [(s, k.tobytes(), one) for s, k in enumerate(keys) for _ in range(times)]
    table = pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["segment", "keys", "n"])
    return keys, table.to_batches(max_chunksize=7)


def test_a_counting_task_holds_one_segment(spark, monkeypatch):
    keys, batches = partials(32, 40000, 3)
    count = kernel_of(spark, monkeypatch, lambda df: lm._counted(df, "text", lm.LOG_BASE, lm.BITS_PER_ENTRY))
    out = pa.Table.from_batches(count(iter(batches)))
    kind, key, n = (out[c].to_numpy() for c in ("kind", "key", "n"))
    words = keys[keys & np.uint64(1) == 0]
    assert (np.sort(key[kind == lm._WORD].view(np.uint64)) == np.sort(words)).all() and (n[kind == lm._WORD] == 3).all()
    assert n[kind == lm._TYPES].sum() == keys.size - len(words) and n[kind == lm._TIMES].sum() == 3 * (keys.size - len(words))
    assert len(np.unique(key[kind == lm._TYPES])) == (kind == lm._TYPES).sum()
    del out, kind, key, n, words
    assert peak_mb(lambda: [None for _ in count(iter(batches))]) < 24


def test_tokens_of_small_slices(spark, monkeypatch, batch):  # noqa: F811
    monkeypatch.setattr(lm, "_HELD", 1 << 17)
    run = kernel_of(spark, monkeypatch, lambda df: lm._partial_counts(df, "text", 64))
    got = [x for b in run(iter([batch])) for x in b.column("n").to_pylist()]
    assert sum(int(np.frombuffer(x, dtype="<i4").sum()) for x in got) == 2 * 1000 * 601
    assert peak_mb(lambda: [None for _ in run(iter([batch]))]) < 24
