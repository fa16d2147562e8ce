"""Numpy helpers over the bytes of many texts at once.

A batch of texts is one ``uint8`` buffer with offsets, so that lower-casing, splitting at white space and
hashing run over whole arrays instead of over Python strings. White space is the six ASCII bytes 0x20 and
0x09-0x0D; bytes of longer UTF-8 sequences never collide with them or with A-Z.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_LETTER = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n of the hash base (or of its inverse), modulo 2**64."""
    name = "inverse" if inverse else "base"
    have = _powers.get(name)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, _BASE_INV if inverse else _BASE, dtype=U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums P with P[j]-P[i] the polynomial of bytes i..j-1, still to be divided by base**i."""
    out = np.empty(len(data) + 1, dtype=U64)
    out[0] = 0
    np.cumsum(_LETTER[data] * _power(len(data))[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal spans have equal hashes."""
    inverse = _power(len(prefix), inverse=True)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64))


def window_hash(prefix: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` bytes, by start."""
    n = len(prefix) - 1 - length + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    return mix((prefix[length:] - prefix[:n]) * _power(len(prefix), inverse=True)[:n] + U64(length))


def chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about ``max_bytes``; a longer row comes alone. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        wide = np.int32
    else:
        wide = np.int64
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(off, off[first] + max_bytes, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, buf[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and what their arrays held stays theirs."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes outside ``space``; none crosses the end of its text."""
    if len(data) == 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    ink = ~space[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    begins[inner] = ink[inner]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    before = inner[inner > 0] - 1
    ends[before] = ink[before]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return start, end, row
