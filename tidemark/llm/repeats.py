"""Removal of repeated byte strings by bucket-pointer refinement.

Every start p of a string of ``length`` bytes is put in a bucket by one q-gram inside the string: the one with
the smallest hash (the last such), its *anchor*. Equal strings have equal anchors at equal offsets, so repeats
meet only inside a bucket, and consecutive starts with one anchor travel as one *run*.

* Initial buckets are those of the anchors' q-grams. A bucket of one run is finished; one whose runs are all equal
  is settled as a whole (all but its first run repeat). The first run of each class in another bucket is cut into
  *pieces* of ``PIECE`` neighbouring offsets from the anchor, and the same is done once more with the string that
  all starts of a piece share, its *core*. Hashes only finish and settle buckets here.
* The pieces left are refined by bucket numbers. Their q-grams are sorted and numbered in that order; then a bucket is
  refined by sorting on the pair of its number and the number of the bucket at a later offset, and the pairs are
  numbered in turn, so that each pass reuses the numbers of the one before and tells twice the width apart, until
  the whole core has a number. A start is at last refined by the bytes before the core, the number of the core at
  that later offset, and the bytes behind it. Whatever is alone in its bucket drops out of all later passes.

Only the first member of each class in an unsettled bucket goes on, so the refinement follows the number of places
where copies begin or end and not the amount copied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import materialize, shape, text_key
from .textarrays import U64, chunks, mix, prefix_hash, span_hash, window_hash

PIECE = 8
#: A bucket of one such part of all rows, or more, is joined by broadcast: there are at most so many.
HOT_SHARE = 2000
#: Bytes whose runs are made at once; each takes several arrays of 8 bytes a byte.
_SLICE = 1 << 18
_LOW = U64((1 << 24) - 1)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values) - width + 1
    low, k = values, 1
    while k * 2 <= width:
        low = np.minimum(low[: len(low) - k], low[k:])
        k *= 2
    return np.minimum(low[:n], low[width - k : width - k + n])


def _slices(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, position of the slice in it, bytes, offsets); only a long single text comes in several slices."""
    for first, data, offsets in chunks(column, _SLICE):
        if len(offsets) > 2 or len(data) <= 2 * _SLICE:
            yield first, 0, data, offsets
        else:
            for at in range(0, len(data) - length + 1, _SLICE):
                part = data[at : at + _SLICE + length - 1]
                yield first, at, part, np.array([0, len(part)])


class Runs:
    """The runs of one slice: row, first start ``low``, ``count`` of starts, ``offset`` of the anchor from low."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, q: int):
        self.data = data
        none = np.empty(0, dtype=np.int64)
        self.row = self.low = self.count = self.offset = none
        self.key = self.cover = np.empty(0, dtype=U64)
        n = len(data) - length + 1
        if n <= 0:
            return
        prefix = prefix_hash(data)
        grams = window_hash(prefix, q)
        ranked = (grams & ~_LOW) | (_LOW - np.arange(len(grams), dtype=U64))
        anchor = (_LOW - (_sliding_min(ranked, length - q + 1) & _LOW)).astype(np.int64)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
        last = offsets[1:] - length
        new = np.ones(n, dtype=bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        low = np.flatnonzero(new)
        high = np.minimum(np.append(low[1:], n) - 1, last[row[low]])
        whole = high >= low
        low, high = low[whole], high[whole]
        self.row, self.low, self.count = row[low], low, high - low + 1
        self.offset = anchor[low] - low
        self.key = grams[anchor[low]]
        shape = (self.offset * 4096 + self.count).astype(U64)
        self.cover = mix(span_hash(prefix, low, high + length) ^ mix(shape))


class Pieces:
    """Runs cut by blocks of offsets from the anchor: run, first start in it, number of starts, key and cover."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, count: np.ndarray, offset: np.ndarray, length: int):
        prefix = prefix_hash(data)
        run = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        block = (offset[run] - at) // PIECE
        new = np.ones(len(run), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (block[1:] != block[:-1])
        head = np.flatnonzero(new)
        self.run, self.first = run[head], at[head]
        self.count = np.diff(np.append(head, len(run)))
        near = block[head] * PIECE
        # the bytes that all starts at offsets near..near+PIECE-1 have in common
        core = offsets[self.run] + offset[self.run] - near
        self.key = mix(span_hash(prefix, core, core - (PIECE - 1) + length) ^ mix(near.astype(U64) + U64(1 << 20)))
        shape = ((offset[self.run] - self.first) * 4096 + self.count).astype(U64)
        self.begin = offsets[self.run] + self.first
        self.end = self.begin + self.count - 1 + length
        self.cover = mix(span_hash(prefix, self.begin, self.end) ^ mix(shape + U64(1 << 40)))
        self.before = core - self.begin


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _unsettled(keys: DataFrame) -> tuple[bloom.Bloom, bloom.Bloom]:
    """From rows (key, cover): filters of the keys met twice or more, and of those with several covers."""
    groups = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("cover").alias("lo"), F.max("cover").alias("hi"))
    again = materialize(groups.where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("several")), "buckets")
    n, several = again.agg(F.count("*"), F.count_if("several")).first()
    return bloom.plain(again.select("key"), bloom.size_for(n)), bloom.plain(again.where("several").select("key"), bloom.size_for(several))


def _first_of_each(rows: DataFrame, key: list[str], extra: list[str]) -> DataFrame:
    """The first member (smallest id, then start) of each class."""
    order = F.struct("id", "low", "text_key", "count", *extra)
    return rows.groupBy(*key).agg(F.min(order).alias("x")).select("x.*")


def _numbered(members: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``members``, a stored table, with the number of each one's bucket (null if it is alone), in the order of ``keys``.

    A key of at least a 2000th of all rows is joined by broadcast, and there are at most 2000 of those; so no task
    gets more than that share of the rows from one key.
    """
    buckets = members.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").orderBy(*keys)
    buckets = materialize(buckets.withColumn("bucket", F.monotonically_increasing_id()), name)
    many = F.col("n") >= max(members.count() / HOT_SHARE, 2)
    hot, rest = buckets.where(many).drop("n"), buckets.where(~many).drop("n")
    in_hot = members.join(F.broadcast(hot), keys)
    others = members.join(F.broadcast(hot.drop("bucket")), keys, "left_anti").join(rest, keys, "left")
    return in_hot.unionByName(others)


def _steps(width: int, q: int) -> list[tuple[int, list[int]]]:
    """(width told apart, offsets at which it is needed) of each pass, from q-grams to strings of ``width`` bytes."""
    widths = [min(q, width)]
    while widths[-1] < width:
        widths.append(min(2 * widths[-1], width))
    out = [(width, [0])]
    for narrow, wide in zip(widths[-2::-1], widths[:0:-1], strict=True):
        out.append((narrow, sorted({x for o in out[-1][1] for x in (o, o + wide - narrow)})))
    return out[::-1]


def refined(pieces: DataFrame, length: int, q: int) -> tuple[DataFrame, DataFrame]:
    """(spans that are unique as a whole, first starts of each class of equal strings), both (id, text_key, low, count).

    ``pieces``, a stored table, has a number ``piece``, ``bytes`` and the bytes ``offset`` before the core in each.
    """
    core = length - PIECE + 1
    (width, offsets), *later = _steps(core, q)
    at = F.explode(F.array(*[F.lit(o) for o in offsets])).alias("at")
    grams = pieces.select("piece", "bytes", "offset", at).select("piece", "at", F.expr(f"substring(bytes, offset + at + 1, {width})").alias("gram"))
    numbers = _numbered(materialize(grams, "grams"), ["gram"], "buckets")
    for wide, needed in later:
        # a piece whose bucket is unique at any place has a unique core
        have = numbers.groupBy("piece").agg(*[F.max(F.when(F.col("at") == o, F.col("bucket"))).alias(f"at{o}") for o in offsets]).dropna()
        pairs = F.array(*[F.struct(F.lit(o).alias("at"), F.col(f"at{o}").alias("own"), F.col(f"at{o + wide - width}").alias("next")) for o in needed])
        members = materialize(have.select("piece", F.inline(pairs)), "pairs")
        numbers = _numbered(members, ["own", "next"], "buckets")
        width, offsets = wide, needed
    cores = materialize(numbers.where("bucket is not null").select("piece", "bucket"), "cores")
    joined = pieces.join(cores, "piece", "left")
    alone = joined.where("bucket is null").select("id", "text_key", "low", "count")
    several = joined.where("bucket is not null").select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("i"))
    starts = several.select(
        "id",
        "text_key",
        (F.col("low") + F.col("i")).alias("low"),
        F.lit(1).alias("count"),
        F.expr("substring(bytes, i + 1, offset - i)").alias("left"),
        "bucket",
        F.expr(f"substring(bytes, offset + {core + 1}, {length - core} - offset + i)").alias("right"),
    )
    return alone, _first_of_each(starts, ["left", "bucket", "right"], []).select("id", "text_key", "low", "count")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, q: int = 24) -> tuple[DataFrame, bloom.Bloom]:
    """(id, text_key, keeps) and a filter: which starts of ``length``-byte strings do not repeat an earlier one.

    Runs whose key the filter lacks are unique. Of the other runs, exactly the starts in ``keeps`` (an array of
    start * 4096 + number of starts) have no earlier equal.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    two = "key long, cover long"

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in _slices(batch.column("text"), length):
                runs = Runs(data, offsets, length, q)
                yield pa.RecordBatch.from_arrays([pa.array(runs.key.view(np.int64)), pa.array(runs.cover.view(np.int64))], names=["key", "cover"])

    again, several = _unsettled(texts.select("text").mapInArrow(keys, two))
    shared_again, shared_several = spark.sparkContext.broadcast(again), spark.sparkContext.broadcast(several)
    members = shape(texts.select("id", "text_key"), "key long, cover long, low long, count int, offset int, bytes binary")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, at, data, offsets in _slices(batch.column("text"), length):
                runs = Runs(data, offsets, length, q)
                pick = np.flatnonzero(shared_again.value.contains(runs.key))
                open_ = shared_several.value.contains(runs.key[pick])
                low, count = runs.low[pick], runs.count[pick]
                raw = data.tobytes()
                held = [raw[i : i + c + length - 1] if o else None for i, c, o in zip(low.tolist(), count.tolist(), open_.tolist(), strict=True)]
                row = runs.row[pick]
                at_row = pa.array(row + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(at_row),
                        batch.column("text_key").take(at_row),
                        pa.array(runs.key[pick].view(np.int64)),
                        pa.array(runs.cover[pick].view(np.int64)),
                        pa.array(low - offsets[row] + at),
                        pa.array(count.astype(np.int32)),
                        pa.array(runs.offset[pick].astype(np.int32)),
                        pa.array(held, pa.binary()),
                    ],
                    names=members.names,
                )

    firsts = materialize(_first_of_each(texts.mapInArrow(candidates, members), ["key", "cover"], ["offset", "bytes"]), "runs")
    settled = firsts.where("bytes is null").select("id", "text_key", "low", "count")
    opened = firsts.where("bytes is not null")

    def piece_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, offset = _ints(batch, "count"), _ints(batch, "offset")
            for first, data, offsets in chunks(batch.column("bytes"), _SLICE):
                rows = slice(first, first + len(offsets) - 1)
                p = Pieces(data, offsets, count[rows], offset[rows], length)
                yield pa.RecordBatch.from_arrays([pa.array(p.key.view(np.int64)), pa.array(p.cover.view(np.int64))], names=["key", "cover"])

    again2, several2 = _unsettled(opened.select("low", "count", "offset", "bytes").mapInArrow(piece_keys, two))
    shared_again2, shared_several2 = spark.sparkContext.broadcast(again2), spark.sparkContext.broadcast(several2)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, count, offset = _ints(batch, "low"), _ints(batch, "count"), _ints(batch, "offset")
            for first, data, offsets in chunks(batch.column("bytes"), _SLICE):
                rows = slice(first, first + len(offsets) - 1)
                p = Pieces(data, offsets, count[rows], offset[rows], length)
                twice = shared_again2.value.contains(p.key)
                mixed = twice & shared_several2.value.contains(p.key)
                raw = data.tobytes()
                held = [raw[i:j] if m else None for i, j, m in zip(p.begin.tolist(), p.end.tolist(), mixed.tolist(), strict=True)]
                at = pa.array(p.run + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(at),
                        batch.column("text_key").take(at),
                        pa.array(p.key.view(np.int64)),
                        pa.array(p.cover.view(np.int64), mask=~twice),
                        pa.array(low[p.run + first] + p.first),
                        pa.array(p.count.astype(np.int32)),
                        pa.array(p.before.astype(np.int32)),
                        pa.array(held, pa.binary()),
                    ],
                    names=members.names,
                )

    # a piece that is met once has no cover; it is written once and stays
    cut = materialize(opened.select("id", "text_key", "low", "count", "offset", "bytes").mapInArrow(pieces, members), "pieces")
    alone = cut.where("cover is null").select("id", "text_key", "low", "count")
    firsts2 = _first_of_each(cut.where("cover is not null"), ["key", "cover"], ["offset", "bytes"])
    firsts2 = materialize(firsts2.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    settled2 = firsts2.where("bytes is null").select("id", "text_key", "low", "count")
    alone2, settled3 = refined(firsts2.where("bytes is not null"), length, q)
    keeps = settled.union(alone).union(settled2).union(alone2).union(settled3)
    packed = keeps.groupBy("id", "text_key").agg(F.collect_list(F.col("low") * 4096 + F.col("count")).alias("keeps"))
    return packed, again


def _covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each of ``size`` places lies in one of the spans [start, end)."""
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(steps)[:size] > 0


def _removed(text: bytes, keeps: np.ndarray, again: bloom.Bloom, length: int, q: int) -> np.ndarray:
    """Whether each byte of a text is covered by a string that starts earlier too."""
    data = np.frombuffer(text, dtype=np.uint8)
    n = max(len(data) - length + 1, 0)
    lows, counts = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for at in range(0, n, _SLICE) if len(data) > 2 * _SLICE else range(0, min(n, 1)):
        part = data[at : at + _SLICE + length - 1] if len(data) > 2 * _SLICE else data
        runs = Runs(part, np.array([0, len(part)]), length, q)
        pick = again.contains(runs.key)
        lows.append(runs.low[pick] + at)
        counts.append(runs.count[pick])
    low, count = np.concatenate(lows), np.concatenate(counts)
    repeat = _covered(n, low, low + count) & ~_covered(n, keeps // 4096, keeps // 4096 + keeps % 4096)
    where = np.flatnonzero(repeat)
    return _covered(len(data), where, where + length)


def _whole_characters(text: bytes, gone: np.ndarray) -> np.ndarray:
    """The same removal, but a character of which a byte stays, stays whole."""
    head = np.flatnonzero((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)
    if not len(head):
        return gone
    return np.repeat(np.minimum.reduceat(gone, head), np.diff(np.append(head, len(text))))


def _apply(docs: DataFrame, id_col: str, text_col: str, length: int, q: int, digest: Callable, schema, carry: list[str]) -> DataFrame:
    keeps, again = repeated_spans(docs, id_col, text_col, length, q)
    shared = docs.sparkSession.sparkContext.broadcast(again)
    keyed = docs.withColumn("_tidemark_key", text_key(F.col(text_col)))
    keeps = keeps.select(F.col("id").alias("_tidemark_id"), F.col("text_key").alias("_tidemark_text"), F.col("keeps").alias("_tidemark_keeps"))
    on = keyed[id_col].eqNullSafe(F.col("_tidemark_id")) & (F.col("_tidemark_key") == F.col("_tidemark_text"))
    wanted = keyed.join(keeps, on, "left").select(*[F.col(c) for c in carry], F.col(text_col).alias("_tidemark_in"), "_tidemark_keeps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kept = batch.column("_tidemark_in"), batch.column("_tidemark_keeps")
            rows = []
            for i in range(len(batch)):
                text = (texts[i].as_py() or "").encode()
                gone = _removed(text, np.array(kept[i].as_py() or [], dtype=np.int64), shared.value, length, q)
                rows.append(digest(text, gone))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(list(x)) for x in zip(*rows, strict=True)], names=schema.names)

    return wanted.mapInArrow(run, schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, q: int = 24) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): what removal of repeated strings leaves of each text.

    A byte goes if some ``length``-byte string over it also starts earlier: in a document with a smaller id, or
    in the same one at an earlier place. Texts are UTF-8 bytes, null is empty, matches never cross texts, and
    strings are judged on the input. A null id counts as the smallest; rows with one id count as one document
    read more than once, so equal strings at equal places in them do not repeat each other. Texts shorter than
    ``length`` stay. An empty table gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = shape(slim.select("id"), "n_bytes long, n_removed long, n_spans long, kept_sha256 string")

    def digest(text: bytes, gone: np.ndarray) -> tuple:
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
        left = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
        return len(text), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()

    return _apply(slim, "id", "text", length, q, digest, schema, ["id"])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars", length: int = 100, q: int = 24) -> DataFrame:
    """``docs`` with repeated strings cut out of the text and the character count put right; all columns stay.

    As :func:`repeats`, except that a character of which any byte stays is kept whole. Texts that become empty
    are dropped, as are null and empty ones.
    """
    carry = [c for c in docs.columns if c not in (text_col, n_chars_col)]
    schema = shape(docs.select(*carry), "_tidemark_out string")

    def digest(text: bytes, gone: np.ndarray) -> tuple:
        gone = _whole_characters(text, gone)
        return (np.frombuffer(text, dtype=np.uint8)[~gone].tobytes().decode("utf-8", "replace"),)

    out = _apply(docs, id_col, text_col, length, q, digest, schema, carry).where("_tidemark_out != ''")
    size = {n_chars_col: F.length("_tidemark_out").cast(docs.schema[n_chars_col].dataType)} if n_chars_col in docs.columns else {}
    made = {text_col: F.col("_tidemark_out")} | size
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])
