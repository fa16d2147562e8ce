"""Bloom filters built on the cluster, segment by segment, and probed with numpy in tasks.

``block`` and ``found`` are filters of any size for the keys of one segment, built and probed where they lie.

A key's segment is a slice of its hash, so each segment is built whole by one task from a bounded share of
the keys, and only the finished bits, whose size is fixed beforehand, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import U64, mix

#: So small that even a small filter has many segments, and none is a large share of the keys.
SEGMENT_BITS = 1 << 16
_SALT = U64(0xC2B2AE3D27D4EB4F)


def size_for(keys: int, bits_per_key: int = 14, max_bits: int = 1 << 28) -> int:
    """Bits of a filter: a power of two, at least one segment, never over ``max_bits``."""
    bits = SEGMENT_BITS
    while bits < keys * bits_per_key and bits < max_bits:
        bits *= 2
    return bits


def _places(keys: np.ndarray, level: int, bits: int, hashes: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(segment, 64-bit word within it, bits within that word) of each key at a level.

    All bits of a key at a level lie in one word, so a probe reads memory once.
    """
    base = mix(keys.astype(U64))
    x = mix(base + U64(int(_SALT) * (level + 1) % (1 << 64)))
    return base & U64(bits // SEGMENT_BITS - 1), x >> U64(64 - 10), [(x >> U64(6 * j)) & U64(63) for j in range(hashes)]


class Bloom:
    """A set of (key, level) pairs with no false negatives."""

    def __init__(self, data: np.ndarray, bits: int, hashes: int):
        self.data, self.bits, self.hashes = data, bits, hashes

    def contains(self, keys: np.ndarray, level: int = 0) -> np.ndarray:
        segment, word, places = _places(keys, level, self.bits, self.hashes)
        wanted = np.zeros(len(keys), dtype=U64)
        for bit in places:
            wanted |= U64(1) << bit
        return self.data[segment * U64(SEGMENT_BITS // 64) + word] & wanted == wanted

    def levels(self, keys: np.ndarray, most: int) -> np.ndarray:
        """The longest run 1..q of levels found for each key: its quantised log count, 0 if absent."""
        out = np.zeros(len(keys), dtype=np.int64)
        alive = np.arange(len(keys))
        for level in range(1, most + 1):
            alive = alive[self.contains(keys[alive], level)]
            if not len(alive):
                break
            out[alive] = level
        return out


def build(keys: DataFrame, bits: int, hashes: int = 5) -> Bloom:
    """Filter of the rows (key long, first int, last int): each key at the levels first..last."""
    n_segments = bits // SEGMENT_BITS

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (mix(batch.column("key").to_numpy().view(U64)) & U64(n_segments - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["key", "first", "last", "segment"])

    def part(table: pa.Table) -> pa.Table:
        marks = np.zeros(SEGMENT_BITS, dtype=bool)
        k, lo, hi = table["key"].to_numpy().view(U64), table["first"].to_numpy(), table["last"].to_numpy()
        for level in range(int(lo.min()), int(hi.max()) + 1):
            _, word, places = _places(k[(lo <= level) & (level <= hi)], level, bits, hashes)
            for bit in places:
                marks[word * U64(64) + bit] = True
        return pa.table({"segment": table["segment"][:1], "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})

    placed = keys.select("key", F.col("first").cast("byte").alias("first"), F.col("last").cast("byte").alias("last")).mapInArrow(segment, "key long, first byte, last byte, segment int")
    data = np.zeros(bits // 64, dtype=U64)
    size = SEGMENT_BITS // 64
    for row in placed.groupBy("segment").applyInArrow(part, "segment int, bits binary").collect():
        data[row["segment"] * size : (row["segment"] + 1) * size] = np.frombuffer(row["bits"], dtype="<u8")
    return Bloom(data, bits, hashes)


def plain(keys: DataFrame, bits: int, hashes: int = 5) -> Bloom:
    """Filter of the rows (key long), one level."""
    zero = F.lit(0)
    return build(keys.select("key", zero.alias("first"), zero.alias("last")), bits, hashes)


def _masks(keys: np.ndarray, level: int, words: np.ndarray, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bits within it) of each key at a level in a block of ``words`` 64-bit words."""
    x = mix(mix(keys.astype(U64)) + U64(int(_SALT) * (level + 1) % (1 << 64)))
    bits = np.zeros(len(keys), dtype=U64)
    for j in range(hashes):
        bits |= U64(1) << ((x >> U64(6 * j)) & U64(63))
    return ((x >> U64(32)) * words.astype(U64)) >> U64(32), bits


def block(keys: np.ndarray, last: np.ndarray, bits_per_entry: float, hashes: int = 5) -> np.ndarray:
    """The words of a filter of ``keys``, each at the levels 1..last; empty without keys."""
    entries = int(last.sum())
    if not entries:
        return np.zeros(0, dtype=U64)
    words = int(entries * bits_per_entry) // 64 + 4  # with some room where entries are few
    marks = np.zeros(words * 64, dtype=bool)
    for level in range(1, int(last.max()) + 1):
        now = keys[last >= level]
        x = mix(mix(now.astype(U64)) + U64(int(_SALT) * (level + 1) % (1 << 64)))
        word = ((x >> U64(32)) * U64(words)) >> U64(32)
        for j in range(hashes):
            marks[word * U64(64) + ((x >> U64(6 * j)) & U64(63))] = True
    return np.packbits(marks, bitorder="little").view("<u8").astype(U64)


def found(data: np.ndarray, start: np.ndarray, words: np.ndarray, keys: np.ndarray, level: int, hashes: int = 5) -> np.ndarray:
    """Whether each key is there at a level, in its own block: ``words`` words of ``data`` from ``start``."""
    word, bits = _masks(keys, level, words, hashes)
    have = words > 0
    at = np.where(have, start + word.astype(np.int64), 0)
    return have & (data[at] & bits == bits) if len(data) else have & False
