"""Packing tokenised documents into windows of fixed length, with bounded space in each partition."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partition_id, shape

WIDTH = 2048
#: Windows open at a time, in a partition or a merge.
OPEN = 32
#: A gap of at least so many tokens is filled with the head of a document cut for it; a smaller one is padded.
LEAST_CUT = 64
#: Partitions whose leftovers meet in one merge.
FAN_IN = 16
END_ID = 1
#: Texts of these characters only are the same to both tokenisers; others go to the slower one.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")


class _Tokenizer:
    """ids of a text as ``tokenizers`` gives them; by ``tiktoken`` where the same vocabulary lies there as ranks."""

    def __init__(self, path: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or _PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)


_loaded: dict[tuple, _Tokenizer] = {}


def _tokenizer(path: str, ranks: str | None) -> _Tokenizer:
    if (path, ranks) not in _loaded:
        _loaded[path, ranks] = _Tokenizer(path, ranks)
    return _loaded[path, ranks]


class Packer:
    """Open windows; a piece goes to the one it fits best, and the fullest is closed when none fits."""

    def __init__(self, first_sequence: int, width: int, slots: int, least_cut: int):
        self.next, self.width, self.slots, self.least_cut = first_sequence, width, slots, least_cut
        self.windows: list[list] = []
        self.gaps: list[int] = []
        self.closed: list[tuple] = []

    def add(self, doc: object, start: int, ids: np.ndarray, doc_tokens: int) -> None:
        while len(ids) >= self.width:
            self._close([(doc, start, ids[: self.width], doc_tokens)])
            start, ids = start + self.width, ids[self.width :]
        while len(ids):
            fit = [(g, i) for i, g in enumerate(self.gaps) if g >= len(ids)]
            if fit:
                return self._put(min(fit)[1], (doc, start, ids, doc_tokens))
            if len(self.windows) < self.slots:
                self.windows.append([])
                self.gaps.append(self.width)
                continue
            fullest = self.gaps.index(min(self.gaps))
            gap = self.gaps[fullest]
            if gap >= self.least_cut:
                self._put(fullest, (doc, start, ids[:gap], doc_tokens))
                start, ids = start + gap, ids[gap:]
            else:
                self._take(fullest)

    def _put(self, i: int, piece: tuple) -> None:
        self.windows[i].append(piece)
        self.gaps[i] -= len(piece[2])
        if not self.gaps[i]:
            self._take(i)

    def _take(self, i: int) -> None:
        self._close(self.windows.pop(i))
        self.gaps.pop(i)

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc, start, ids, doc_tokens in pieces:
            self.closed.append((doc, start, ids, doc_tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Close what is open: the emptiest windows fill the fullest, the last is cut at powers of two."""
        pieces = [p for _, w in sorted(zip(self.gaps, self.windows, strict=True), key=lambda x: x[0]) for p in w]
        self.windows, self.gaps = [], []
        left = sum(len(p[2]) for p in pieces)
        while pieces:
            room = self.width if left >= self.width else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, ids, doc_tokens = pieces.pop(0)
                if len(ids) > room:
                    pieces.insert(0, (doc, start + room, ids[room:], doc_tokens))
                    ids = ids[:room]
                window.append((doc, start, ids, doc_tokens))
                room -= len(ids)
            self._close(window)

    def rows(self, with_ids: bool, leftovers: bool) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("doc", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
        every = list(self.closed)
        if leftovers:
            every += [(*p, None, 0) for w in self.windows for p in w]
        for doc, start, ids, doc_tokens, sequence, offset in every:
            raw = ids.astype("<u4").tobytes()
            for k, v in zip(out, (doc, start, len(ids), zlib.crc32(raw), doc_tokens, sequence, offset, raw if with_ids or sequence is None else None), strict=True):
                out[k].append(v)
        self.closed = []
        return out


_PIECE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, open_windows: int = OPEN, least_cut: int = LEAST_CUT, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of all documents in their windows.

    Each partition tokenises its documents, ends each with END_ID and packs them as they come, keeping
    ``open_windows`` windows open: best fit first; if a piece fits in none, the fullest is closed, filled by a
    piece cut for it if its gap is ``least_cut`` or more. What is still open at the end, a bounded number of
    windows for each partition, is merged by the same rule in rounds of FAN_IN partitions each; the last round
    closes everything, cutting the last window at powers of two, which need no padding.

    ``tokenizer`` is a file of the tokenizers library, ``ranks`` the same vocabulary for tiktoken (faster). Null and empty texts are
    END_ID alone. Null ids and repeated rows are packed like others; other columns are not read; an empty table
    gives an empty result. ``ids`` (with_ids) holds a piece's ids as little-endian unsigned 32-bit integers.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = shape(slim.select("id"), _PIECE)

    def batch_of(ids: pa.Array, cols: dict[str, list], part: int) -> pa.RecordBatch:
        n = len(cols["start"])
        arrays = [ids, *(pa.array(cols[k], pa.int64()) for k in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), pa.array(cols["ids"], pa.binary()), pa.array([part] * n, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _tokenizer(tokenizer, ranks), partition_id()
        packer = Packer(part << 32, width, open_windows, least_cut)
        kind = None
        for batch in batches:
            kind = batch.column("id").type
            for doc, text in zip(batch.column("id"), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                packer.add(doc.as_py(), 0, ids, len(ids))
            rows = packer.rows(with_ids, False)
            yield batch_of(pa.array(rows["doc"], kind), rows, part)
        if kind is not None:
            rows = packer.rows(with_ids, True)
            yield batch_of(pa.array(rows["doc"], kind), rows, part)

    def merger(round_: int, last: bool) -> Callable[[pa.Table], pa.Table]:
        def merge(table: pa.Table) -> pa.Table:
            group = table.column("part")[0].as_py() // FAN_IN
            packer = Packer((round_ << 56) | (group << 32), width, open_windows, least_cut)
            for r in table.sort_by([(k, "descending") for k in ("length", "ids_crc32", "start", "doc_tokens")]).to_pylist():
                packer.add(r["id"], r["start"], np.frombuffer(r["ids"], dtype="<u4"), r["doc_tokens"])
            if last:
                packer.finish()
            rows = packer.rows(with_ids, True)
            return pa.Table.from_batches([batch_of(pa.array(rows["doc"], table.schema.field("id").type), rows, group)])

        return merge

    first = materialize(slim.mapInArrow(run, schema), "packed")
    parts = (first.agg(F.max("part")).first()[0] or 0) + 1
    done, left = [first.where("sequence_id is not null")], first.where("sequence_id is null")
    round_ = 0
    while True:
        round_, parts = round_ + 1, -(-parts // FAN_IN)
        last = parts <= 1

        grouped = left.groupBy(F.floor(F.col("part") / FAN_IN))
        merged = materialize(grouped.applyInArrow(merger(round_, last), schema), "merged")
        done.append(merged.where("sequence_id is not null"))
        left = merged.where("sequence_id is null")
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else []))
