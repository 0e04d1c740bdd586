"""Quality of documents by positive-unlabelled learning.

Positives are trusted documents labelled good; the other side is unlabelled web
text, good and bad mixed. With the class prior p of good documents in the mix, the
risk of calling a bad one good is what the mix says less p times what the
positives say; it is kept from falling below zero (the non-negative estimator).

The prior is estimated from the same two samples: a first classifier tells
positives from the mix, and the prior is the smallest ratio, over its scores'
upper ends, of the mix's share to the positives' share, each with its allowance
for chance. Bad labels are never used.

Features are statistics of a whole text (repetition, marks, capitals, lengths),
cut into ranges; the model is logistic over these ranges.

Defined results: null and empty texts have the statistics 0 and are scored like
any other; without positives or without a mix the score is the prior, 0.5.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec.llm.common import is_held_out, texts_of
from tradespec.llm.learning import fitted, labelled_sample, plain_sample

#: The most labelled rows that positives are taken from, and the size of the mix.
TRAINING_ROWS = 12_000
UNLABELLED_ROWS = 12_000
THRESHOLD = 0.7
RANGES = 16

_TABLE = bytes.maketrans(
    bytes(range(256)),
    bytes(
        1 if c in b"abcdefghijklmnopqrstuvwxyz"
        else 2 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        else 3 if c in b"0123456789"
        else 4 if c in b" \t\r"
        else 5 if c == 10
        else 6 if c in b".,;:'\"-()"
        else 7 if c in b"!?"
        else 8 if c < 128
        else 9
        for c in range(256)
    ),
)
_CLASSES = [bytes([n]) for n in range(10)]


def statistics(text: str) -> list[float]:
    """Shares and means that describe a text."""
    raw = text.encode("utf-8", "replace").translate(_TABLE)
    size = max(len(raw), 1)
    shares = [raw.count(c) / size for c in _CLASSES[1:]]
    letters = max(shares[0] + shares[1] + shares[8], 1e-9)
    words = text.split()
    n = max(len(words), 1)
    counts = Counter(words)
    top = sum(c for _, c in counts.most_common(1)) / n
    repeated = sum(map(str.__eq__, words, words[1:])) / n
    pairs = len(set(zip(words, words[1:]))) / n
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, words)) / n
    wordy = sum(map(str.isalpha, words)) / n
    single = sum(c == 1 for c in counts.values()) / n
    return [
        *shares,
        shares[1] / letters,
        len(counts) / n,
        len(counts) / n**0.75,
        top,
        repeated,
        pairs,
        upper,
        wordy,
        single,
        len(text) / n,
        max(map(len, words), default=0),
        np.log1p(len(words)),
        len(set(lines)) / max(len(lines), 1),
        len(words) / max(len(lines), 1),
        text.count(".") / n,
        text.count(",") / n,
    ]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _ranges(values: np.ndarray) -> list[np.ndarray]:
    """Cuts of each statistic: quantiles of the mix, closer together at both ends."""
    steps = np.unique(np.concatenate([np.linspace(0.05, 0.95, RANGES - 4), [0.005, 0.02, 0.98, 0.995]]))
    return [np.unique(np.quantile(column, steps)) for column in values.T]


def _columns(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Indexes of the ranges that the statistics are in, numbered through."""
    out, at = np.empty(values.shape, np.int64), 0
    for i, cut in enumerate(cuts):
        out[:, i] = at + np.searchsorted(cut, values[:, i], side="right")
        at += len(cut) + 1
    return out


def _descend(size: int, slope, epochs: int, rate: float = 0.05) -> np.ndarray:
    """Adam from zero; ``slope`` of weights, whose last is the bias."""
    weights, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, epochs + 1):
        g = slope(weights)
        first = 0.9 * first + 0.1 * g
        second = 0.99 * second + 0.01 * g * g
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def _slope(columns: np.ndarray, pull: np.ndarray, size: int) -> np.ndarray:
    flat = np.bincount(columns.ravel(), np.repeat(pull, columns.shape[1]), minlength=size)
    return np.append(flat, pull.sum())


def estimated_prior(positive: np.ndarray, mixed: np.ndarray) -> float:
    """The share of positives in the mix, from the scores of both (best-bin estimate)."""
    cuts = np.unique(np.quantile(positive, np.linspace(0.0, 0.95, 60)))
    of_positive = 1 - np.searchsorted(np.sort(positive), cuts, side="left") / len(positive)
    of_mixed = 1 - np.searchsorted(np.sort(mixed), cuts, side="left") / len(mixed)
    slack = np.sqrt(np.log(20) / (2 * len(positive))) + np.sqrt(np.log(20) / (2 * len(mixed)))
    best = np.argmin((of_mixed + slack) / np.maximum(of_positive, 1e-9))
    return float(np.clip(of_mixed[best] / max(of_positive[best], 1e-9), 0.05, 0.98))


def fit(rows: pd.DataFrame, epochs: int = 300) -> bytes:
    """Train on ``text`` and ``trusted`` (1: trusted positive, 0: of the mix)."""
    trusted = rows["trusted"].to_numpy() == 1
    if not trusted.any() or trusted.all():
        return b""
    values = np.array([statistics(t) for t in rows["text"]])
    cuts = _ranges(values[~trusted])
    columns = _columns(values, cuts)
    size = sum(len(c) + 1 for c in cuts)
    p, u = columns[trusted], columns[~trusted]

    def margin(weights: np.ndarray, at: np.ndarray) -> np.ndarray:
        return weights[at].sum(axis=1) + weights[-1]

    # The classifier behind the prior learns from half of the rows, and is read on the rest.
    rng = np.random.default_rng(10)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    p1, u1 = p[::2], u[::2]

    def against_mix(weights: np.ndarray) -> np.ndarray:
        down = _slope(p1, (_sigmoid(margin(weights, p1)) - 1) / len(p1), size)
        up = _slope(u1, _sigmoid(margin(weights, u1)) / len(u1), size)
        return down + up + 1e-3 * weights

    first = _descend(size, against_mix, epochs // 2)
    prior = 0.5
    if len(p) > 1 and len(u) > 1:
        prior = estimated_prior(margin(first, p[1::2]), margin(first, u[1::2]))

    def non_negative(weights: np.ndarray) -> np.ndarray:
        mp, mu = margin(weights, p), margin(weights, u)
        sp, su = _sigmoid(mp), _sigmoid(mu)
        # Log loss of calling a document bad is log(1 + e^margin), its slope the sigmoid.
        risk = np.logaddexp(0, mu).mean() - prior * np.logaddexp(0, mp).mean()
        bad = _slope(u, su / len(u), size) - prior * _slope(p, sp / len(p), size)
        good = prior * _slope(p, (sp - 1) / len(p), size)
        return (good + bad if risk >= 0 else -bad) + 2e-4 * weights

    weights = _descend(size, non_negative, epochs)
    return pickle.dumps((cuts, weights, prior))


def train(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = TRAINING_ROWS,
    unlabelled: int = UNLABELLED_ROWS,
) -> bytes:
    """A model from bounded samples outside the held-out fold.

    ``rows`` labelled rows give the positives, ``unlabelled`` documents the mix.
    """
    positives = labelled_sample(docs, labels, "quality", rows).filter("label = 1")
    mixed = plain_sample(docs, unlabelled)
    sample = positives.select("doc_id", "text", F.lit(1).alias("trusted")).unionByName(
        mixed.select("doc_id", "text", F.lit(0).alias("trusted"))
    )
    return fitted(sample, fit)


def scorer(model: bytes):
    """A function from texts to scores."""
    if not model:
        return lambda texts: np.full(len(texts), 0.5)
    cuts, weights, _ = pickle.loads(model)

    def run(texts) -> np.ndarray:
        values = np.array([statistics(t) for t in texts]).reshape(len(texts), len(cuts))
        return _sigmoid(weights[_columns(values, cuts)].sum(axis=1) + weights[-1])

    return run


def scores(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, whole texts."""
    return (
        texts_of(docs)
        .select("doc_id", score_of(docs, model)(F.col("text")).alias("score"))
        .select(
            "doc_id",
            is_held_out(F.col("doc_id")).alias("held_out"),
            "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
        )
    )


def score_of(docs: DataFrame, model: bytes):
    """A column function that scores texts; null counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer(sent.value)
        for batch in batches:
            yield pd.Series(score(batch.fillna("")), dtype="float64")

    return F.pandas_udf(run, "double")


def keep(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns."""
    return docs.filter(score_of(docs, model)(F.col("text").cast("string")) >= threshold)
