"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters are words (lexicon) and word beginnings (patterns) whose presence goes with the label in a bounded sample of labelled texts. The label
model takes each voter to fire with one rate in toxic and another in clean texts, estimates both by expectation
maximisation over labelled and unlabelled texts, and the correlation of voters within a class; a voter that
fires along with others counts for less. A logistic classifier on the voters is trained on the posterior labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, shape
from .textarrays import U64, chunks, lower, mix, prefix_hash, span_hash, words

#: Documented bounds of the fit: labelled texts of each class, unlabelled texts, voters.
TEXTS_PER_CLASS = 3000
UNLABELLED = 3000
MOST_VOTERS = 1500
#: A voter fires in at least so many toxic sample texts, and so many times as often as in clean ones.
LEAST_SUPPORT = 12
LEAST_LIFT = 12.0
#: Lengths in bytes of the word beginnings that are patterns.
PATTERNS = (4, 5, 6)
THRESHOLD = 0.7
#: How sure a given label is taken to be.
LABEL_TRUST = 0.99
_LETTER = np.ones(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = False


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all words of letters and their beginnings, with repeats."""
    data = lower(data)
    start, end, row = words(data, offsets, _LETTER)
    prefix = prefix_hash(data)
    hashes, rows = [span_hash(prefix, start, end)], [row]
    for n in PATTERNS:
        long = end - start > n
        hashes.append(mix(span_hash(prefix, start[long], start[long] + n) ^ U64(n)))
        rows.append(row[long])
    return np.concatenate(hashes), np.concatenate(rows)


class Model:
    """Voters with their weights; bounded by MOST_VOTERS."""

    def __init__(self, voters: np.ndarray, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(voters & U64(0xFFFF)).astype(np.int64)] = True

    def fired(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, voter) of each voter that fires in a text, once."""
        if not len(self.voters):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        hashes, row = _features(data, offsets)
        pick = self.maybe[(hashes & U64(0xFFFF)).astype(np.int64)]
        hashes, row = hashes[pick], row[pick]
        at = np.minimum(np.searchsorted(self.voters, hashes), len(self.voters) - 1)
        hit = self.voters[at] == hashes
        both = np.unique(row[hit] * len(self.voters) + at[hit])
        return both // len(self.voters), both % len(self.voters)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, voter = self.fired(data, offsets)
        total = np.bincount(row, weights=self.weights[voter], minlength=len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -40, 40)))


def label_model(votes: np.ndarray, gold: np.ndarray, prior: float, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each row, log weights of each voter) from votes (rows x voters) and gold labels (-1: none).

    The rates at which voters fire in either class are fitted by expectation maximisation, labels being one more
    voter of trust LABEL_TRUST. A silent voter abstains: only that none fires at all is evidence, as one voter more. A
    voter's weight is divided by the sum of its squared correlations (shared variance) with all voters within the
    classes, so that many voters on one word count as about one, and loosely related ones as themselves.
    """
    votes = np.hstack([votes, votes.sum(1, keepdims=True) == 0])
    post = np.where(gold < 0, prior, np.where(gold == 1, LABEL_TRUST, 1 - LABEL_TRUST))
    share = np.ones(votes.shape[1])
    for i in range(rounds):
        a = (post @ votes + 0.5) / (post.sum() + 1)
        b = ((1 - post) @ votes + 0.05) / ((1 - post).sum() + 1)
        if i in (rounds // 3, 2 * rounds // 3):  # once the classes are told apart, else their difference counts as correlation
            left = votes - np.outer(post, a) - np.outer(1 - post, b)
            deviation = np.sqrt(np.maximum((left**2).sum(0), 1e-9))
            related = (left.T @ left / np.outer(deviation, deviation)) ** 2
            share = 1 / np.maximum(np.where(related > 0.04, related, 0).sum(0), 1)
            share[-1] = 1
        fire = np.log(a / b) * share
        log_odds = votes @ fire + np.log(prior / (1 - prior))
        trust = np.log(LABEL_TRUST / (1 - LABEL_TRUST))
        log_odds += np.where(gold < 0, 0, np.where(gold == 1, trust, -trust))
        post = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
    return post, fire[:-1]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: np.ndarray, ridge: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft labels, by accelerated gradient steps from ``start``."""
    weight = weight / weight.sum()
    w = np.append(start, -2.0)
    x1 = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)])
    moment, square = np.zeros(len(w)), np.zeros(len(w))
    for i in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -40, 40)))
        g = x1.T @ (weight * (p - y))
        g[:-1] += ridge * w[:-1] / len(w)
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= 0.1 * (moment / (1 - 0.9**i)) / (np.sqrt(square / (1 - 0.99**i)) + 1e-8)
    return w[:-1], float(w[-1])


def _families(found: list[np.ndarray]) -> np.ndarray:
    """A number for each sample text that near copies mostly share: its smallest feature that few texts have."""
    every = np.concatenate(found or [np.zeros(0, dtype=U64)])
    features, counts = np.unique(every, return_counts=True)
    few = features[(counts >= 2) & (counts <= max(60, len(found) // 100))]
    out = np.arange(len(found), dtype=U64)
    for i, f in enumerate(found):
        at = np.minimum(np.searchsorted(few, f), max(len(few) - 1, 0))
        own = f[few[at] == f] if len(few) else f[:0]
        if len(own):
            out[i] = own.min()
    return np.unique(out, return_inverse=True)[1]


def learn(found: list[np.ndarray], gold: np.ndarray, prior: float) -> Model:
    """Voters and weights from the feature sets of sample texts and their labels (-1: none).

    A voter's support counts families of near copies, so that the words of one much copied text do not vote.
    """
    family = _families(found)

    def firing(label: int) -> tuple[np.ndarray, np.ndarray, int]:
        of = np.flatnonzero(gold == label)
        if not len(of):
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), 1
        every = np.concatenate([found[i] for i in of])
        who = np.repeat(family[of], [len(found[i]) for i in of])
        features, at = np.unique(every, return_inverse=True)
        pairs = np.unique(at * (family.max() + 1) + who)
        return features, np.bincount(pairs // (family.max() + 1), minlength=len(features)), len(np.unique(family[of]))

    toxic, in_toxic, n_toxic = firing(1)
    clean, in_clean, n_clean = firing(0)
    strong = in_toxic >= min(LEAST_SUPPORT, max(2, n_toxic // 20))
    toxic, in_toxic = toxic[strong], in_toxic[strong]
    at = np.minimum(np.searchsorted(clean, toxic), max(len(clean) - 1, 0))
    other = np.where(clean[at] == toxic, in_clean[at], 0) if len(clean) else np.zeros(len(toxic))
    lift = (in_toxic / n_toxic) / ((other + 0.2) / n_clean)
    good = np.flatnonzero(lift >= LEAST_LIFT)
    good = good[np.argsort(-(in_toxic[good] * np.log(lift[good])), kind="stable")][:MOST_VOTERS]
    voters = np.sort(toxic[good])
    if not len(voters):
        return Model(voters, np.zeros(0), -3.0)
    votes = np.zeros((len(found), len(voters)), dtype=np.float32)
    for i, f in enumerate(found):
        at = np.minimum(np.searchsorted(voters, f), len(voters) - 1)
        votes[i, at[voters[at] == f]] = 1
    posterior, fire = label_model(votes, gold, prior)
    # rows weigh as their class does among all labelled rows
    toxic_rows, clean_rows, rest = (max((gold == k).sum(), 1) for k in (1, 0, -1))
    weight = np.where(gold == 1, prior / toxic_rows, np.where(gold == 0, (1 - prior) / clean_rows, 1 / rest))
    weights, bias = _logistic(votes, posterior, weight, fire)
    return Model(voters, np.maximum(weights, 0), bias)


def fit(docs: DataFrame, labels: DataFrame, train_when: Column, id_col: str = "doc_id", text_col: str = "text", texts_per_class: int = TEXTS_PER_CLASS, unlabelled: int = UNLABELLED) -> Model:
    """Fit on hash samples of about ``texts_per_class`` labelled texts of each class where ``train_when`` holds,
    and about ``unlabelled`` others; equal texts count once. Without toxic or clean labels no voter is found and
    every score is small.
    """
    known = labels.where(train_when & F.col("toxic").isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    known = materialize(known.where("_id is not null"), "labels")
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not count.get(0) or not count.get(1):
        return Model(np.zeros(0, dtype=U64), np.zeros(0), -3.0)
    draw = F.pmod(F.xxhash64("_id", F.lit("t")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, min(1.0, texts_per_class / count[1])).otherwise(min(1.0, texts_per_class / count[0]))
    sample = F.broadcast(known.where(draw < rate))
    total = docs.count()
    more = docs.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("u")), F.lit(1 << 30)) / float(1 << 30) < min(1.0, unlabelled / max(total, 1)))
    labelled = docs.join(sample, docs[id_col] == sample["_id"]).select(F.col(text_col).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    rows = labelled.unionByName(more.select(F.col(text_col).alias("text"), F.lit(-1).alias("toxic")))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in chunks(batch.column("text")):
                n = len(offsets) - 1
                hashes, row = _features(data, offsets)
                order = np.lexsort((hashes, row))
                hashes, row = hashes[order], row[order]
                new = np.append(True, (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=bool)
                bounds = np.searchsorted(row[new], np.arange(n + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(bounds), pa.array(hashes[new].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("toxic")[first : first + n], found], names=["toxic", "found"])

    got = rows.mapInArrow(listed, "toxic int, found array<bigint>").toArrow().combine_chunks()
    seen: dict[bytes, tuple[int, np.ndarray]] = {}
    lists, labels_ = got.column("found").combine_chunks(), got.column("toxic").to_numpy()
    bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(U64)
    for i in np.argsort(-labels_, kind="stable"):
        found = flat[bounds[i] : bounds[i + 1]]
        seen.setdefault(found.tobytes(), (int(labels_[i]), found))
    pairs = sorted(seen.items())
    gold = np.array([label for _, (label, _) in pairs])
    found = [f for _, (_, f) in pairs]

    return learn(found, gold, count[1] / (count[0] + count[1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(carried columns, score): how likely each whole text is toxic, from 0 to 1, from its words alone.

    Null and empty texts get the score of a text in which no voter fires. Null ids, repeated rows and other
    columns change nothing; an empty table gives an empty result.
    """
    carry = [id_col] if carry is None else carry
    slim = docs.select(*carry, F.col(text_col).alias("_tidemark_text"))
    schema = shape(docs.select(*carry), "score double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.scores(data, offsets) for _, data, offsets in chunks(batch.column("_tidemark_text"))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(np.concatenate(out) if out else np.zeros(0))], names=schema.names)

    return slim.mapInArrow(run, schema)
