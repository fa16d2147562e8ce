"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Counts of words and of word pairs are gathered over all training texts. Each count c is quantised to a level
1 + floor(log_b c), and the n-gram is put into a Bloom filter at all levels up to its own; a reader probes level
after level until one is missing, and takes the mean count of the last level found. The filter lies in blocks, by
segments of the keys and classes of levels, built where the counts of a segment are. Blocks of the higher classes are
broadcast, as many as a fixed room holds; those of pairs met once or twice never are, as they are most of the filter
at any size. Tokens that these do not tell are sent to the blocks of their segment, and rare words are joined with
their counts: each n-gram seen in training counts in every score, whatever the size of the corpus.

A pair (h, w) has probability (c(hw) + T(h) P(w)) / (c(h) + T(h)), T the number of different followers
(Witten-Bell), with T and c of the history known by classes of its hash, and P(w) = (c(w) + 1) / (N + V + 1).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import materialize, partition_id, release, shape
from .textarrays import U64, chunks, give_back, lower, mix, prefix_hash, span_hash, words

LOG_BASE = 1.5
MOST_LEVELS = 64
#: Classes of histories: the low bits of a word's hash, kept in the keys of its pairs.
CLASS_BITS = 16
#: Words whose exact counts go to all tasks; the counts of the others are joined.
COMMON_WORDS = 1 << 19
#: Bits of the blocks that are broadcast, at most.
MAX_BITS = 1 << 29
BITS_PER_ENTRY = 10
#: The lowest level of each class of blocks.
CLASSES = np.array([1, 2, 3, 5, 9, 14])
#: Classes of pairs, from the lowest, that score() never broadcasts.
ASKED = 2
LEAST_TYPES = 1e-9
#: Keys a task gathers before it passes on their counts, and questions before it passes on those.
_HELD = 1 << 20
_HELD_QUESTIONS = 1 << 20
#: Bytes of text a kernel takes at a time; its arrays take many times as much.
_BYTES = 1 << 18

END = int(mix(np.array([0x454E44], dtype=U64))[0])
START = int(mix(np.array([0x5354415254], dtype=U64))[0])
_CLASS = U64((1 << CLASS_BITS) - 1)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all tokens: the words of each text and one end."""
    data = lower(data)
    start, end, row = words(data, offsets)
    n = len(offsets) - 1
    per = np.bincount(row, minlength=n)
    ends = np.cumsum(per + 1) - 1
    out = np.empty(len(row) + n, dtype=U64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[ends] = True
    out[is_end] = U64(END)
    out[~is_end] = span_hash(prefix_hash(data), start, end)
    return out, np.repeat(np.arange(n), per + 1)


def _histories(tokens: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The token before each, START at a text's first."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, dtype=bool)
    before[first] = U64(START)
    return before


def _word_keys(tokens: np.ndarray) -> np.ndarray:
    """Keys of words are even, those of pairs odd."""
    return tokens & ~U64(1)


def _pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Keys of pairs: the history's class above the lowest bit, a hash of both above it."""
    both = mix(before * U64(0x9E3779B97F4A7C15) + tokens)
    return (both << U64(CLASS_BITS + 1)) | ((before & _CLASS) << U64(1)) | U64(1)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], np.add.reduceat(counts[order], heads)


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> U64(40)) & U64(segments - 1)).astype(np.int64)


def _level(n: np.ndarray, base: float) -> np.ndarray:
    return np.minimum(1 + np.floor(np.log(n) / math.log(base) + 1e-9), MOST_LEVELS).astype(np.int64)


def _middle(level: np.ndarray, base: float) -> np.ndarray:
    """The count that a level stands for; 0 for none."""
    return np.where(level > 0, np.maximum((base ** (level - 1.0) + base ** (level * 1.0) - 1) / 2, 1.0), 0.0)


def _smoothed(both: np.ndarray, count: np.ndarray, history: np.ndarray, ratio: np.ndarray, total: int) -> np.ndarray:
    """log10 probability of tokens, from the counts of pair, token and history and the history's followers per time."""
    own = (count + 1) / total
    types = np.maximum(history * ratio, LEAST_TYPES)
    return np.log10(np.where(history > 0, (np.minimum(both, history) + types * own) / (history + types), own))


def _dealt(segment: np.ndarray, segments: int, arrays: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each segment met, with the bytes of each array's items there; a fraction of what rows for items take."""
    segment = segment.astype(np.uint16 if segments <= 1 << 16 else np.uint32)
    order = np.argsort(segment, kind="stable")
    met, first = np.unique(segment[order], return_index=True)
    bounds = np.append(first, len(order))
    held = []
    for a in arrays.values():  # the cast fails where offsets do not fit
        offsets = pa.array(bounds * a.itemsize).cast(pa.int32()).buffers()[1]
        held.append(pa.Array.from_buffers(pa.binary(), len(met), [None, offsets, pa.py_buffer(a[order])]))
    return pa.RecordBatch.from_arrays([pa.array(met.astype(np.int64)), *held], names=["segment", *arrays])


def _items(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """The items of all rows of a column that _dealt() made, where they lie if that is in one piece."""
    if isinstance(column, pa.ChunkedArray):
        parts = [_items(x, kind) for x in column.chunks]
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=kind), *parts])
    if not len(column):
        return np.zeros(0, dtype=kind)
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]].view(kind)


def _by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(segment, keys, counts) with the counts of a key summed, of rows (segment, keys, n) where those of a segment stand together."""
    segment, size = -1, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return _summed(keys, n.astype(np.int64, copy=False))

    for batch in batches:
        own = batch.column("segment").to_numpy()
        bounds = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)) if len(own) else own
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            if held and own[first] != segment:
                yield segment, *merged()
                size = 0
            segment = int(own[first])
            held.append((_items(batch.column("keys")[first:last], "<u8"), _items(batch.column("n")[first:last], "<i4")))
            size += len(held[-1][0])
            if size > max(_HELD, len(held[0][0])):
                held, size = [merged()], 0
    if held:
        yield segment, *merged()


def _partial_counts(docs: DataFrame, text_col: str, segments: int) -> DataFrame:
    """(segment, keys, n): counts of words and pairs, summed over some millions of tokens each, dealt to segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            n = np.diff(np.append(heads, len(keys))).astype(np.int32)
            keys = keys[heads]
            del heads
            return _dealt(_segment(keys, segments), segments, {"keys": keys, "n": n})

        give_back()
        for batch in batches:
            for _, data, offsets in chunks(batch.column("text"), _BYTES):
                tokens, row = _tokens(data, offsets)
                held += [_word_keys(tokens), _pair_keys(_histories(tokens, row), tokens)]
                size += 2 * len(tokens)
                del tokens, row, data, offsets
                if size >= _HELD:
                    yield flush()
                    size = 0
            del batch  # else it stays while the next is read
        if held:
            yield flush()
        give_back()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "segment long, keys binary, n binary")


_ROWS = "kind int, key long, n long, bits binary"
_WORD, _TYPES, _TIMES, _BLOCK, _SIZE = range(5)


def _counted(docs: DataFrame, text_col: str, base: float, bits_per_entry: float) -> tuple[DataFrame, int]:
    """The materialised counts of all texts, and the number of segments: words with their counts, followers and
    occurrences of each class of histories, and blocks (key: segment, order and class; n: words of 64 bits).

    A segment is a slice of the keys. A task sorts its rows by segment and holds the keys of one segment at a time,
    counts them whole and builds their blocks on the spot.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = 1 << max(6, (8 * parts - 1).bit_length())

    def rows(kind: int, key: np.ndarray, n: np.ndarray, bits: list[bytes] | None = None) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(key), kind, dtype=np.int32))
        held = pa.nulls(len(key), pa.binary()) if bits is None else pa.array(bits, pa.binary())
        return pa.RecordBatch.from_arrays([kinds, pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64)), held], names=["kind", "key", "n", "bits"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        types, times = np.zeros(1 << CLASS_BITS, dtype=np.int64), np.zeros(1 << CLASS_BITS, dtype=np.int64)
        for segment, keys, n in _by_segment(batches):
            pair = (keys & U64(1)) == 1
            yield rows(_WORD, keys[~pair].view(np.int64), n[~pair])
            which = ((keys[pair] >> U64(1)) & _CLASS).astype(np.int64)
            types += np.bincount(which, minlength=len(types))
            times += np.bincount(which, weights=n[pair], minlength=len(times)).astype(np.int64)
            level = _level(n, base)
            place = (segment * 2 + pair) * len(CLASSES) + np.searchsorted(CLASSES, level, side="right") - 1
            order = np.argsort(place, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(place[order]) != 0))
            for at in np.split(order, cuts[1:]):
                bits = bloom.block(keys[at], level[at], bits_per_entry)
                yield rows(_BLOCK, place[at[:1]], np.array([len(bits)]), [bits.tobytes()])
        for kind, x in ((_TYPES, types), (_TIMES, times)):
            some = np.flatnonzero(x)
            yield rows(kind, some, x[some])
        give_back()

    out = materialize(_partial_counts(docs, text_col, segments).repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(count, _ROWS), "counts")
    release(spark)
    return out, segments


class Blocks:
    """Blocks of some classes: a mapping from keys to levels."""

    def __init__(self, places: np.ndarray, blocks: list[np.ndarray], segments: int):
        self.segments = segments
        self.words = np.zeros(segments * 2 * len(CLASSES), dtype=np.int64)
        self.words[places] = [len(b) for b in blocks]
        self.start = np.zeros(len(self.words), dtype=np.int64)
        self.start[places] = np.cumsum([0, *map(len, blocks)])[:-1]
        self.data = np.concatenate(blocks) if blocks else np.zeros(0, dtype=U64)
        shape = self.words.reshape(segments, 2, len(CLASSES))
        self.classes = [np.flatnonzero(shape[:, order].any(0)) for order in (0, 1)]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if no block holds it; all keys are words or all are pairs."""
        out = np.zeros(len(keys), dtype=np.int64)
        if not len(keys):
            return out
        order = int(keys[0] & U64(1))
        home = (_segment(keys, self.segments) * 2 + order) * len(CLASSES)
        open_ = np.arange(len(keys))
        for c in self.classes[order][::-1]:
            alive, last = open_, CLASSES[c + 1] - 1 if c + 1 < len(CLASSES) else MOST_LEVELS
            reached = np.zeros(len(keys), dtype=np.int64)
            for level in range(1, last + 1):
                at = home[alive] + c
                alive = alive[bloom.found(self.data, self.start[at], self.words[at], keys[alive], level)]
                if not len(alive):
                    break
                reached[alive] = level
            got = reached[open_] >= CLASSES[c]
            out[open_[got]] = reached[open_[got]]
            open_ = open_[~got]
        return out


class Model:
    """The broadcast part of a trained model; its size has fixed bounds.

    ``words_open`` and ``pairs_open`` say that the blocks lack some words or pairs that were seen.
    """

    def __init__(self, blocks: Blocks, n: int, v: int, ratio: np.ndarray, common: tuple[np.ndarray, np.ndarray], base: float, words_open: bool, pairs_open: bool):
        self.blocks, self.n, self.v, self.ratio, self.common, self.base = blocks, n, v, ratio, common, base
        self.words_open, self.pairs_open = words_open, pairs_open

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts: the middle of the last level found, 0 if none. The keys are all words or all pairs."""
        return _middle(self.blocks.levels(keys), self.base)

    def types(self, before: np.ndarray) -> np.ndarray:
        """Different followers of a history for each time it occurs."""
        return self.ratio[(before & _CLASS).astype(np.int64)]

    def log10(self, pair: np.ndarray, count: np.ndarray, history: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of tokens, from the keys of their pairs and the counts of token and history."""
        return self.smoothed(self.counts(pair), count, history, before)

    def smoothed(self, both: np.ndarray, count: np.ndarray, history: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 probability of tokens, from the counts of pair, token and history."""
        return _smoothed(both, count, history, self.types(before), self.n + self.v + 1)

    def exact(self, keys: np.ndarray) -> np.ndarray:
        """Counts of common words, 0 of others."""
        have, counts = self.common
        if not len(have):
            return np.zeros(len(keys), dtype=np.int64)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, counts[at], 0)


def train(docs: DataFrame, text_col: str = "text", **options: float) -> tuple[Model, DataFrame]:
    """(model, word counts (key, n)) of all texts of ``docs``."""
    return _trained(docs, text_col, **options)[:2]


def _trained(docs: DataFrame, text_col: str, max_bits: int = MAX_BITS, common_words: int = COMMON_WORDS, base: float = LOG_BASE, asked: int = 0) -> tuple[Model, DataFrame, DataFrame]:
    """(model, word counts (key, n), blocks (segment, place, bits) of pairs that are not in the model) of all texts.

    The model lacks the ``asked`` lowest classes of pairs, and such others as ``max_bits`` has no room for.
    """
    rows, segments = _counted(docs, text_col, base, BITS_PER_ENTRY)
    single = rows.where(F.col("kind") == _WORD).select("key", "n")
    classes = rows.where(F.col("kind").isin(_TYPES, _TIMES)).groupBy("kind", "key").agg(F.sum("n").alias("n")).toPandas()
    types, times = (classes[classes["kind"] == k] for k in (_TYPES, _TIMES))
    ratio = np.ones(1 << CLASS_BITS)
    ratio[types["key"]] = types["n"]
    ratio[times["key"]] /= times["n"]

    # the most frequent words, as many as there is room for: all above a count taken from the levels
    level = F.least(F.lit(MOST_LEVELS), F.floor(F.ln("n") / math.log(base) + 1e-9) + 1)
    histogram = single.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.sum("n").alias("n")).orderBy(F.desc("level")).collect()
    n, v = sum(r["n"] for r in histogram), sum(r["v"] for r in histogram)
    floor_, room = MOST_LEVELS + 1, common_words
    for r in histogram:
        room -= r["v"]
        if room < 0:
            break
        floor_ = r["level"]
    common = single.where(level >= floor_).toArrow()
    keys, counts = common.column("key").to_numpy().view(U64), common.column("n").to_numpy()
    by_key = np.argsort(keys)

    # the classes that are broadcast: pairs leave first, by rising counts
    block = rows.where(F.col("kind") == _BLOCK)
    order, kind = F.floor(F.col("key") / len(CLASSES)) % 2, F.col("key") % len(CLASSES)
    sizes = {(r["o"], r["c"]): 64 * r["n"] for r in block.groupBy(order.alias("o"), kind.alias("c")).agg(F.sum("n").alias("n")).collect()}
    least = [0, asked]
    while sum(x for (o, c), x in sizes.items() if c >= least[o]) > max_bits:
        least[1 if least[1] <= least[0] + 1 + asked and least[1] < len(CLASSES) else 0] += 1
    inside = kind >= F.when(order == 0, least[0]).otherwise(least[1])
    got = block.where(inside).select("key", "bits").toArrow()
    places, blocks = got["key"].to_numpy(), [np.frombuffer(b.as_buffer(), dtype="<u8") for b in got["bits"]]
    is_open = [any(x and c < least[o] for (o, c), x in sizes.items() if o == own) for own in (0, 1)]
    del got
    model = Model(Blocks(places, blocks, segments), n, v, ratio, (keys[by_key], counts[by_key]), base, *is_open)
    lacking = block.where(~inside & (order == 1)).select(F.floor(F.col("key") / (2 * len(CLASSES))).alias("segment"), F.col("key").alias("place"), "bits")
    return model, single, lacking


def _lists(row: np.ndarray, item: np.ndarray, n: int, arrays: dict[str, np.ndarray]) -> list[pa.Array]:
    """For rows 0..n-1 the lists of their different items: each array taken at the items, then how often they come."""
    pairs, times = np.unique(row * (item.max() + 1 if len(item) else 1) + item, return_counts=True)
    width = item.max() + 1 if len(item) else 1
    bounds = pa.array(np.searchsorted(pairs // width, np.arange(n + 1)).astype(np.int32))
    at = pairs % width
    return [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (*(a[at] for a in arrays.values()), times.astype(np.int32))]


def score(docs: DataFrame, train_when: Column, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    The model learns from the rows where ``train_when`` holds. Tokens are words, A-Z lower-cased, and one end for
    each text, so a null or empty text is an end alone. base_score is exact: log10((c + 1) / (N + V + 1)) over the
    tokens, counts of words being equal where 64-bit hashes of words are; counts of common words are at hand in
    every task, and rows of the other words are joined with their counts. score is log10 of the model's
    probability; tokens that the broadcast blocks do not tell are sent to the other blocks, if there are any. Null ids
    and repeated rows are scored like others; a table without training rows gives every token the same
    probability; an empty table gives an empty result.
    """
    learn = docs.where(train_when)
    model, singles, lacking = _trained(learn, text_col, **{"asked": ASKED, **options})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("id"), (~F.coalesce(train_when, F.lit(False))).alias("held_out"), F.col(text_col).alias("text"))
    rare = "keys array<bigint>, times array<int>"
    untold = "pair array<bigint>, word array<bigint>, before array<bigint>, own array<tinyint>, past array<tinyint>, often array<int>"
    schema = shape(slim.select("id", "held_out"), f"row long, n_tokens long, n_known long, base double, score double, {rare}, {untold}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        row_id = partition_id() << 40
        give_back()
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text"), _BYTES):
                n = len(offsets) - 1
                tokens, row = _tokens(data, offsets)
                before = _histories(tokens, row)
                word, back = np.unique(_word_keys(tokens), return_inverse=True)
                level = m.blocks.levels(word)
                count = _middle(level, m.base)
                missing = m.words_open & (count == 0)
                pair, at, inverse = np.unique(_pair_keys(before, tokens), return_index=True, return_inverse=True)
                # of each different pair: its history's place among the words, -1 at a text's first
                past = np.where(before[at] == U64(START), -1, back[np.maximum(at - 1, 0)])
                own, history = count[back[at]], np.where(past < 0, 0, count[past])
                followed = np.where(past < 0, 0, level[past])
                both = m.counts(pair)
                no_word, no_past = missing[back[at]], missing[past] & (past >= 0)
                is_open = (m.pairs_open & (both == 0) & (followed > 0)) | no_word | no_past
                log = np.where(is_open, 0, m.smoothed(both, own, history, before[at]))
                told = {
                    "pair": pair.view(np.int64),
                    "word": np.where(no_word, word[back[at]], 0).view(np.int64),
                    "before": np.where(no_past, word[past], 0).view(np.int64),
                    "own": level[back[at]].astype(np.int8),
                    "past": followed.astype(np.int8),
                }
                exact = m.exact(word)
                # the filter may lack words that were seen, so each word that is not common is joined
                seldom = np.flatnonzero((exact == 0)[back])
                opened = np.flatnonzero(is_open[inverse])
                part = slice(first, first + n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id")[part],
                        batch.column("held_out")[part],
                        pa.array(np.arange(row_id, row_id + n)),
                        pa.array(np.bincount(row, minlength=n)),
                        pa.array(np.bincount(row, weights=(exact > 0)[back], minlength=n).astype(np.int64)),
                        pa.array(np.bincount(row, weights=np.log10(exact + 1.0)[back], minlength=n)),
                        pa.array(np.bincount(row, weights=log[inverse], minlength=n)),
                        *_lists(row[seldom], back[seldom], n, {"keys": word.view(np.int64)}),
                        *_lists(row[opened], inverse[opened], n, told),
                    ],
                    names=schema.names,
                )
                row_id += n
                del data, offsets
            del batch  # else it stays while the next is read
        give_back()

    scored = materialize(slim.mapInArrow(run, schema), "scored")
    shared.unpersist()
    release(docs.sparkSession)
    rare = scored.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
    known = rare.join(singles, "key")
    more = known.select("row", F.col("times").cast("long").alias("known"), (F.col("times") * F.log10(F.col("n") + 1)).alias("base"), F.lit(0.0).alias("score"))
    if model.words_open or model.pairs_open:
        told = materialize(_untold(scored, singles, lacking, model), "told")
        release(docs.sparkSession)
        more = more.union(told)
    found = more.groupBy("row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more"), F.sum("score").alias("more_score"))
    out = scored.select("id", "held_out", "row", "n_tokens", "n_known", "base", "score").join(found, "row", "left")
    floor_ = F.lit(math.log10(model.n + model.v + 1))
    return out.select(
        "id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * floor_).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )


def _untold(scored: DataFrame, words_: DataFrame, lacking: DataFrame, model: Model) -> DataFrame:
    """(row, known 0, base 0.0, score): log10 probabilities of the tokens that the model does not tell.

    Words that its blocks lack are joined with their counts. Pairs go to their segment's blocks, with the levels of
    token and history; a task packs its questions by segment.
    """
    names = ["pair", "word", "before", "own", "past", "often"]
    rows = scored.select("row", F.explode(F.arrays_zip(*names)).alias("x")).select("row", *[F.col(f"x.{c}").alias(c) for c in names])
    base, ratio, segments, total = model.base, model.ratio, model.blocks.segments, model.n + model.v + 1
    if model.words_open:
        level = F.least(F.lit(MOST_LEVELS), F.floor(F.ln("n") / math.log(base) + 1e-9) + 1).cast("tinyint")
        for key, known in (("word", "own"), ("before", "past")):
            told, rest = rows.where(F.col(key) == 0), rows.where(F.col(key) != 0)
            rest = rest.join(words_.select(F.col("key").alias(key), level.alias("seen")), key, "left")
            rows = told.unionByName(rest.withColumn(known, F.coalesce("seen", known)).select(told.columns))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row, pair, own, past, often = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            pair = pair.view(U64)
            levels = own.astype(np.uint16) | past.astype(np.uint16) << 8
            return _dealt(_segment(pair, segments), segments, {"rows": row, "pairs": pair, "levels": levels, "often": often})

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy().copy() for c in ("row", "pair", "own", "past", "often")))
            size += len(batch)
            if size >= _HELD_QUESTIONS:
                yield flush()
                size = 0
        if held:
            yield flush()
        give_back()

    def probe(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        row, keys, levels, often = (_items(asked[c], t) for c, t in (("rows", "<i8"), ("pairs", "<u8"), ("levels", "<u2"), ("often", "<i4")))
        have = Blocks(blocks["place"].to_numpy() % (2 * len(CLASSES)), [np.frombuffer(b, dtype="<u8") for b in blocks["bits"].to_pylist()], 1)
        different, at = np.unique(keys, return_inverse=True)
        both = _middle(have.levels(different), base)[at]
        followers = ratio[((keys >> U64(1)) & _CLASS).astype(np.int64)]
        log = _smoothed(both, _middle(levels & 255, base), _middle(levels >> 8, base), followers, total)
        who, at = np.unique(row, return_inverse=True)
        return pa.table({"row": who, "score": np.bincount(at, weights=often * log, minlength=len(who))})

    questions = rows.where("past > 0").select("row", "pair", "own", "past", "often")
    questions = questions.mapInArrow(pack, "segment long, rows binary, pairs binary, levels binary, often binary")
    out = questions.groupBy("segment").cogroup(lacking.groupBy("segment")).applyInArrow(probe, "row long, score double")
    if model.words_open:  # else each question has a history
        middle = F.greatest((F.pow(F.lit(base), F.col("own") - 1) + F.pow(F.lit(base), "own") - 1) / 2, F.lit(1.0))
        alone = F.log10((F.when(F.col("own") > 0, middle).otherwise(0.0) + 1) / total)
        out = out.union(rows.where("past = 0").select("row", (F.col("often") * alone).alias("score")))
    return out.groupBy("row").agg(F.sum("score").alias("score")).select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), "score")
