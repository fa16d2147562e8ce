"""Language identification by string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of byte n-grams of up to ``ORDER`` letters present in both (a blended
spectrum of presence, not of counts), normalised by both texts' own numbers. It counts the n-grams that occur in
landmark texts; others, which no landmark shares, are left out on both sides. Landmark texts span the space: a text
becomes its kernel values with the landmarks times the inverse root of the landmarks' own kernel matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shape
from .textarrays import chunks, lower

ORDER = 3
#: Symbols that letters are mapped to; n-grams of rarer bytes share the last one.
ALPHABET = 64
#: Documented bounds of the fit: labelled texts used (but TEXTS_PER_LANGUAGE of each language at least, or all that
#: it has), characters of all texts used, and landmarks (but one of each language at least).
TRAINING_TEXTS = 4000
TEXTS_PER_LANGUAGE = 20
TRAINING_CHARS = 1 << 26
LANDMARKS = 160
RIDGE = 0.1
UNDETERMINED = "und"
_ROWS = 128


def _symbols(sample: list[bytes]) -> np.ndarray:
    """Byte to symbol: 0 for what is no letter, the frequent letters one each."""
    counts = np.zeros(256, dtype=np.int64)
    for t in sample:
        counts += np.bincount(lower(np.frombuffer(t, dtype=np.uint8)), minlength=256)
    letter = np.zeros(256, dtype=bool)
    letter[97:123] = letter[128:] = True
    out = np.zeros(256, dtype=np.int64)
    ranked = sorted(np.flatnonzero(letter), key=lambda b: (-counts[b], b))
    for i, b in enumerate(ranked, 1):
        out[b] = min(i, ALPHABET - 1)
    out[65:91] = out[97:123]
    return out


def _codes(symbols: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code) of all n-grams of each order that lie in one text; a run of non-letters counts once."""
    keep = np.ones(len(symbols), dtype=bool)
    keep[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0) | (row[1:] != row[:-1])
    symbols, row = symbols[keep], row[keep]
    code, base = symbols, ALPHABET
    yield row, code
    for n in range(2, ORDER + 1):
        code = code[:-1] * ALPHABET + symbols[n - 1 :]
        inside = row[n - 1 :] == row[: len(code)]
        yield row[: len(code)][inside], code[inside] + base
        base += ALPHABET**n


class Classifier:
    """Everything that scoring needs, of bounded size."""

    def __init__(self, texts: list[bytes], labels: list[str], landmarks: int, ridge: float):
        self.languages = sorted(set(labels))
        self.symbols = _symbols(texts)
        self.index = np.full(sum(ALPHABET**n for n in range(1, ORDER + 1)), -1, dtype=np.int32)
        # every k-th text of each language in turn, so that each language has landmarks
        by = {c: [t for t, x in zip(texts, labels, strict=True) if x == c] for c in self.languages}
        turns = [by[c][i] for i in range(max(map(len, by.values()), default=0)) for c in self.languages if i < len(by[c])]
        marks = turns[:landmarks]
        found = np.unique(np.concatenate([c for t in marks for _, c in _codes(self.symbols[np.frombuffer(t, dtype=np.uint8)], np.zeros(len(t), dtype=np.int64))] or [np.zeros(0, dtype=np.int64)]))
        self.index[found] = np.arange(len(found), dtype=np.int32)
        self.width = len(found)
        self.marks = np.zeros((0, self.width), dtype=np.float32)
        self.weights = np.zeros((1, len(self.languages)), dtype=np.float32)
        self.root = np.zeros((0, 0), dtype=np.float32)
        if not len(marks) or not self.width:
            return
        self.marks = self._presence(marks)
        norm = np.sqrt(np.maximum(self.marks.sum(1), 1))
        values, vectors = np.linalg.eigh((self.marks @ self.marks.T / np.outer(norm, norm)).astype(np.float64))
        good = values > 1e-6 * values.max()
        self.marks /= norm[:, None]
        self.root = (vectors[:, good] / np.sqrt(values[good])).astype(np.float32)
        x = np.concatenate([self.features(self._presence(texts[i : i + _ROWS])) for i in range(0, len(texts), _ROWS)]).astype(np.float64)
        x = np.hstack([x, np.ones((len(x), 1))])
        place = {c: i for i, c in enumerate(self.languages)}
        y = np.zeros((len(texts), len(self.languages)))
        y[np.arange(len(texts)), [place[c] for c in labels]] = 1
        # each language weighs the same
        w = 1 / y.sum(0)[y.argmax(1)]
        w *= len(w) / w.sum()
        self.weights = np.linalg.solve(x.T @ (x * w[:, None]) + ridge * np.eye(x.shape[1]), x.T @ (y * w[:, None])).astype(np.float32)

    def _presence(self, texts: list[bytes]) -> np.ndarray:
        offsets = np.cumsum([0, *map(len, texts)])
        return self.presence(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts x n-grams) of 0 and 1."""
        out = np.zeros((len(offsets) - 1) * self.width, dtype=np.float32)
        for at in range(0, len(data), 1 << 20):  # long texts in slices that overlap by an n-gram
            part = slice(at, min(at + (1 << 20) + ORDER - 1, len(data)))
            row = np.searchsorted(offsets, np.arange(part.start, part.stop), side="right") - 1
            for r, code in _codes(self.symbols[data[part]], row):
                place = self.index[code]
                known = place >= 0
                out[r[known] * self.width + place[known]] = 1
        return out.reshape(len(offsets) - 1, self.width)

    def features(self, presence: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(presence.sum(1), 1))
        return (presence @ self.marks.T / norm[:, None]) @ self.root

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts x languages) values of the one-versus-rest regressions."""
        out = []
        for i in range(0, len(offsets) - 1, _ROWS):
            part = offsets[i : i + _ROWS + 1]
            x = self.features(self.presence(data[part[0] : part[-1]], part - part[0]))
            out.append(x @ self.weights[:-1] + self.weights[-1])
        return np.concatenate(out)


def fit(docs: DataFrame, train_when: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", texts: int = TRAINING_TEXTS, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
    """Fit on a hash sample of the labelled rows where ``train_when`` holds.

    Every language is learned, from about ``texts`` texts in all with as many of each language as it has, up to an
    equal share. Texts without letters are left out, and those of over TRAINING_CHARS / ``texts`` characters too
    unless their language has no others.
    """
    rows = docs.where(train_when & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    short = F.length(text_col) <= TRAINING_CHARS // texts
    counts = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("count"), F.count_if(short).alias("short")).collect()
    if not counts:
        return Classifier([], [], landmarks, ridge)
    share = max(texts // len(counts), TEXTS_PER_LANGUAGE)
    rate = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, share / (r["short"] or r["count"]))))])
    only_long = F.col(lang_col).isin([r["lang"] for r in counts if not r["short"]])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(short | only_long).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw")).where(F.col("draw") < F.element_at(rate, F.col("lang")))
    got = sample.toPandas().sort_values(["draw", "lang", "text"])
    return Classifier([t.encode("utf-8", "surrogatepass") for t in got["text"]], list(got["lang"]), max(landmarks, len(counts)), ridge)


def identify(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """(carried columns, lang_pred, score): the language of every whole text; ``names`` renames the last two.

    lang_pred is ``und``, with score 0, for a text that is null or has no letter, and where no language was
    learned. score is the value of the winning regression, held to [0, 1]; ties go to the first language by
    name. Null ids, repeated rows and other columns change nothing; an empty table gives an empty result.
    """
    carry = [id_col] if carry is None else carry
    if set(names) & set(carry):
        raise ValueError(f"identify: a carried column has the name of a result, one of {names}")
    source = docs.select(*carry, F.col(text_col).alias("_tidemark_text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_tidemark_letter"))
    schema = shape(docs.select(*carry), f"{names[0]} string, {names[1]} double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        languages = np.array([*m.languages, UNDETERMINED], dtype=object)
        for batch in batches:
            letter = batch.column("_tidemark_letter").to_numpy(zero_copy_only=False)
            best, value = np.full(len(batch), len(languages) - 1), np.zeros(len(batch))
            if m.languages:
                for first, data, offsets in chunks(batch.column("_tidemark_text")):
                    s = m.scores(data, offsets)
                    part = slice(first, first + len(s))
                    best[part], value[part] = s.argmax(1), np.clip(s.max(1), 0, 1)
                best[~letter], value[~letter] = len(languages) - 1, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(languages[best], pa.string()), pa.array(value)], names=schema.names)

    return source.mapInArrow(run, schema)


def accuracy(predicted: pd.DataFrame) -> float:
    """Share of rows (lang, lang_pred) that agree."""
    return float((predicted["lang"] == predicted["lang_pred"]).mean())
