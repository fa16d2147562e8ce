"""Token counts under a unigram vocabulary, by dynamic programming on a trie of distinct pre-tokens."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shape
from .textarrays import U64, chunks, prefix_hash, span_hash, words

MARK = "▁"
#: Terminal nodes whose counts a task keeps from one batch to the next; beyond that it forgets them and counts anew.
MOST_NODES = 1_000_000
#: Characters of a pre-token beyond which its path is kept as a window of the longest piece's length.
LONGEST_PATH = 1 << 14


def unigram_scores(path: str) -> tuple[dict[str, float], float]:
    """(log probability of each piece, that of a fallback byte) of a SentencePiece vocabulary.

    The vocabulary lists its pieces by falling frequency, so the piece of rank r gets probability in proportion to
    1/r (Zipf's law); nothing is trained. A character that is no piece falls back to its UTF-8 bytes, each as
    likely as the last piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - norm for r, p in enumerate(pieces, 1)}, -math.log(len(pieces)) - norm


class CountingTrie:
    """Forward scores of all prefixes of distinct pre-tokens, each computed once; terminal nodes keep a token count.

    A node holds the best log probability of its prefix and the fewest tokens that reach it. Pre-tokens come in
    sorted order, which is the depth-first order of their trie, so only the path to the current node is in memory.
    """

    def __init__(self, scores: dict[str, float], byte_score: float):
        self.byte_score = byte_score
        self.longest = max(map(len, scores), default=1)
        #: Endings of pieces, with the score of those that are pieces: a walk backwards stops where no piece goes on.
        self.endings: dict[str, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))} | scores
        self.keys, self.counts = np.empty(0, dtype=U64), np.empty(0, dtype=np.int64)

    def _extend(self, text: str, i: int, best: list[float], tokens: list[int]) -> None:
        """The node of text[:i], whose shorter prefixes end the lists; the path may lack its oldest nodes."""
        endings, top, count = self.endings, -math.inf, 0
        single = False
        for back in range(1, min(i, self.longest) + 1):
            s = endings.get(text[i - back : i], math.inf)
            if s is None:
                continue
            if s == math.inf:
                break
            single |= back == 1
            s += best[-back]
            n = tokens[-back] + 1
            if s > top or s == top and n < count:
                top, count = s, n
        if not single:
            width = len(text[i - 1].encode("utf-8", "surrogatepass"))
            s, n = best[-1] + width * self.byte_score, tokens[-1] + width
            if s > top or s == top and n < count:
                top, count = s, n
        best.append(top)
        tokens.append(count)

    def terminal_counts(self, pretokens: list[str]) -> list[int]:
        """Tokens of the best segmentation of each pre-token; they are sorted."""
        out, before, best, tokens = [], "", [0.0], [0]
        for word in pretokens:
            text = MARK + word
            if len(text) > LONGEST_PATH:
                out.append(self._long(text))
                continue
            shared = 0
            for a, b in zip(before, text):  # noqa: B905  up to the shorter one's end
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for i in range(shared + 1, len(text) + 1):
                self._extend(text, i, best, tokens)
            out.append(tokens[-1])
            before = text
        return out

    def _long(self, text: str) -> int:
        best, tokens = [0.0], [0]
        for i in range(1, len(text) + 1):
            self._extend(text, i, best, tokens)
            if len(best) > LONGEST_PATH:
                del best[: -self.longest], tokens[: -self.longest]
        return tokens[-1]

    def count(self, word: str) -> int:
        return self.terminal_counts([word])[0]

    def totals(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of each text of a buffer; equal pre-tokens have equal 64-bit hashes."""
        start, end, row = words(data, offsets)
        n = len(offsets) - 1
        key, first, back = np.unique(span_hash(prefix_hash(data), start, end), return_index=True, return_inverse=True)
        if len(self.keys) > MOST_NODES:
            self.keys, self.counts = self.keys[:0], self.counts[:0]
        at = np.searchsorted(self.keys, key)
        known = np.zeros(len(key), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == key[inside]
        raw, new = data.tobytes(), np.flatnonzero(~known)
        spans = zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)
        found = [raw[i:j].decode("utf-8", "surrogatepass") for i, j in spans]
        order = sorted(range(len(found)), key=found.__getitem__)
        counts = np.empty(len(new), dtype=np.int64)
        counts[order] = self.terminal_counts([found[i] for i in order])
        self.keys, self.counts = np.insert(self.keys, at[new], key[new]), np.insert(self.counts, at[new], counts)
        each = self.counts[np.searchsorted(self.keys, key)]
        return np.bincount(row, minlength=n), np.bincount(row, weights=each[back], minlength=n).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pretokens, n_tokens) of every whole text.

    Pre-tokens are the words between ASCII white space, each led by the word mark. A batch's distinct pre-tokens
    that the task has not met are put in a trie and scored; counts of terminal nodes are kept, in bounded number,
    for the next batches of the partition, so equal words and equal beginnings are scored once and no shuffle is
    needed. Null and empty texts count 0; null ids, repeated rows and other columns change nothing; an empty table
    gives an empty result.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = shape(slim.select("id"), "n_pretokens long, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = CountingTrie(*unigram_scores(vocabulary))
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text"), 1 << 22):
                pretokens, tokens = trie.totals(data, offsets)
                ids = batch.column("id").slice(first, len(pretokens))
                yield pa.RecordBatch.from_arrays([ids, pa.array(pretokens), pa.array(tokens)], names=schema.names)

    return slim.mapInArrow(run, schema)
