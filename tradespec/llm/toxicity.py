"""Toxic documents by multiple-instance learning.

A document is a bag of sentences. A sentence's probability comes from a logistic
model of its words; a document's is the noisy-or of its sentences', one minus the
product of what they leave. Training minimises the log loss of document labels
through the noisy-or, so the labels of documents teach which sentences offend.

Scores come from exactly the model that was trained: every weight and the bias.

Defined results: null texts and texts without a sentence score 0. A sentence without
known words has the probability of the bias, so long harmless texts score above 0.
Texts are judged whole, at any length, a sentence at a time. Equal texts have equal
scores, and repeated rows each get their row; rows without an id or a label are scored
like others. With fewer than three labelled rows of either kind no word has a weight.
Other columns of the tables are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec.llm.common import is_held_out, texts_of
from tradespec.llm.learning import fitted, labelled_sample
from tradespec.llm.words import WordCache

TRAINING_ROWS = 8_000
THRESHOLD = 0.3
#: A feature is in so many training documents.
LEAST_DOCUMENTS = 4
#: One of so many folds chooses among the penalties, which are given in documents' pull on a weight.
FOLDS = 3
PENALTIES = (4.0, 2.0, 1.0, 0.5, 0.25, 0.125)
#: The most a sentence without known words counts, as log odds: a thousand such
#: sentences make a noisy-or of 0.12. Training keeps to it.
MOST_BIAS = -9.0
#: A word counts as itself and by its beginnings of these lengths.
BEGINNINGS = (4, 5)
#: Entries of the training matrix handled at once.
_SLICE = 1 << 20
_SENTENCE = re.compile(r"[.!?]+\s|\n+")
_WORD = re.compile(r"[^\W\d_]+")


def sentence_spans(text: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    for m in _SENTENCE.finditer(text):
        spans.append((at, m.end()))
        at = m.end()
    return [(a, b) for a, b in [*spans, (at, len(text))] if text[a:b].strip()]


def features(chunk: str) -> list[str]:
    """What a stretch without white space counts as."""
    return [
        f
        for w in _WORD.findall(chunk)
        for f in (w, *(f"{w[:n]}*" for n in BEGINNINGS if len(w) >= n))
    ]


class Bags:
    """Sentences of many texts as numbered features, each once in a sentence.

    Only numbers are held; features in fewer than ``LEAST_DOCUMENTS`` texts go at the end.
    """

    def __init__(self, texts: Iterable[str]):
        number: dict[str, int] = {}
        chunks = WordCache(lambda c: [number.setdefault(f, len(number)) for f in features(c)])
        words, sizes, owner, documents = array("i"), array("i"), array("i"), Counter()
        for doc, text in enumerate(texts):
            found: set[int] = set()
            for a, b in sentence_spans(text):
                bag = set().union(*map(chunks.__getitem__, text[a:b].lower().split()))
                words.extend(bag)
                sizes.append(len(bag))
                owner.append(doc)
                found |= bag
            documents.update(found)
        names = list(number)
        self.names = sorted(names[i] for i, n in documents.items() if n >= LEAST_DOCUMENTS)
        place = np.full(len(names), -1, np.int32)
        place[[number[name] for name in self.names]] = np.arange(len(self.names), dtype=np.int32)
        self.words = place[np.frombuffer(words, np.int32)]
        self.sentences = np.repeat(np.arange(len(sizes), dtype=np.int32), np.frombuffer(sizes, np.int32))
        known = self.words >= 0
        self.words, self.sentences = self.words[known], self.sentences[known]
        self.owner = np.frombuffer(owner, np.int32).astype(np.int64)

    def _slices(self) -> Iterator[slice]:
        return (slice(i, i + _SLICE) for i in range(0, len(self.words), _SLICE))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """The sum of its features' weights for every sentence."""
        out = np.zeros(len(self.owner))
        for part in self._slices():
            of, first = self.sentences[part], self.sentences[part.start]
            found = np.bincount(of - first, weights[self.words[part]])
            out[first : first + len(found)] += found
        return out

    def back(self, values: np.ndarray) -> np.ndarray:
        """The sum of its sentences' values for every feature."""
        out = np.zeros(len(self.names))
        for part in self._slices():
            out += np.bincount(self.words[part], values[self.sentences[part]], minlength=len(out))
        return out


class _Noisy:
    """Noisy-or training over bags whose documents have ``labels``."""

    def __init__(self, bags: Bags, labels: np.ndarray):
        self.bags, self.labels = bags, labels

    def _forward(self, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the sentences and of the documents."""
        p = 1 / (1 + np.exp(-np.clip(self.bags.sums(weights) + bias, -30, 30)))
        left = np.bincount(
            self.bags.owner, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(self.labels)
        )
        return p, np.clip(-np.expm1(left), 1e-9, 1 - 1e-9)

    def fitted(
        self, used: np.ndarray, pull: float, epochs: int, rate: float
    ) -> tuple[np.ndarray, float]:
        """Weights and bias for the documents in ``used``, by Adam with a proximal step.

        Weights are not negative: a word can only make its sentence likelier to offend.
        Each is drawn to zero by what ``pull`` documents could do at most, and is
        exactly zero where that is more than the documents do.
        """
        weights, bias = np.zeros(len(self.bags.names)), MOST_BIAS
        first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
        of = self.bags.owner
        for step in range(1, epochs + 1):
            p, doc = self._forward(weights, bias)
            slope = np.where(self.labels > 0, -(1 - doc) / doc, 1.0) * used / used.sum()
            dz = p * slope[of]
            slope = np.append(self.bags.back(dz), dz.sum())
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope**2
            size = rate / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
            move = size * first / (1 - 0.9**step)
            weights = np.maximum(weights - move[:-1] - size[:-1] * pull / used.sum(), 0)
            bias = min(MOST_BIAS, bias - move[-1])
        return weights, bias

    def loss(self, judged: np.ndarray, weights: np.ndarray, bias: float) -> float:
        """The log loss of the documents in ``judged``, added up."""
        doc = self._forward(weights, bias)[1][judged]
        return float(-np.log(np.where(self.labels[judged] > 0, doc, 1 - doc)).sum())


def fit(rows: pd.DataFrame, epochs: int = 40, rate: float = 0.3) -> bytes:
    """Train on ``text`` and ``label``; the model's features and their weights.

    The penalty is the one of ``PENALTIES`` whose model of the other rows has the least
    log loss on every ``FOLDS``-th row of either label. They are tried from the
    largest down until the loss has been above its least for two in a row.
    """
    labels = rows["label"].to_numpy(float)
    # Rows of either label in turn, so that a fold has its share of both.
    fold = np.zeros(len(labels), np.int64)
    for mark in (labels > 0, labels <= 0):
        fold[mark] = np.arange(mark.sum()) % FOLDS
    bags = Bags(rows["text"])
    weights, bias = np.zeros(len(bags.names)), MOST_BIAS
    if len(bags.owner) and FOLDS <= (labels > 0).sum() <= len(labels) - FOLDS:
        noisy, losses = _Noisy(bags, labels), []
        for penalty in PENALTIES:
            model = noisy.fitted((fold > 0) * 1.0, penalty, epochs, rate)
            losses.append(noisy.loss(fold == 0, *model))
            if len(losses) - np.argmin(losses) > 2:
                break
        best = PENALTIES[int(np.argmin(losses))]
        weights, bias = noisy.fitted(np.ones(len(labels)), best, epochs, rate)
    kept = {f: float(x) for f, x in zip(bags.names, weights) if x}
    return pickle.dumps((kept, float(bias)))


class Scorer:
    """Judges texts by exactly the noisy-or that was trained."""

    def __init__(self, model: bytes):
        self.weights, self.bias = pickle.loads(model) if model else ({}, MOST_BIAS)
        self._known = WordCache(self._features)
        #: What a sentence without known words leaves, as a logarithm.
        self._plain = self._left(self.bias)

    def _features(self, chunk: str) -> frozenset[str]:
        return frozenset(features(chunk)) & self.weights.keys()

    @staticmethod
    def _left(z: float) -> float:
        """The logarithm of one minus a sentence's probability."""
        return -math.log1p(math.exp(min(max(z, -30.0), 30.0)))

    def judge(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The noisy-or of a text, and its sentences likelier than not to offend."""
        left, found = 0.0, []
        lower = text.lower()
        known = any(map(self._known.__getitem__, set(lower.split())))
        for a, b in sentence_spans(text):
            bag = (
                frozenset().union(*map(self._known.__getitem__, text[a:b].lower().split()))
                if known
                else ()
            )
            if not bag:
                left += self._plain
                continue
            rest = self._left(self.bias + math.fsum(map(self.weights.__getitem__, bag)))
            left += rest
            if -math.expm1(rest) >= 0.5:
                found.append((a, b, -math.expm1(rest)))
        return max(0.0, -math.expm1(left)), found


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> bytes:
    """A model from up to ``rows`` labelled documents outside the held-out fold."""
    return fitted(labelled_sample(docs, labels, "toxic", rows), fit)


def scores(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, offending`` of every row, whole texts.

    ``offending`` has start, end and score of the sentences that offend.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for batch in batches:
            judged = [scorer.judge(t) for t in batch.pop("text")]
            batch["score"] = [x for x, _ in judged]
            batch["offending"] = [
                ",".join(f"{a}:{b}:{p:.3f}" for a, b, p in found) for _, found in judged
            ]
            batch["doc_id"] = batch["doc_id"].astype("Int64")
            yield batch

    return (
        texts_of(docs)
        .mapInPandas(run, "doc_id long, score double, offending string")
        .select(
            "doc_id",
            is_held_out(F.col("doc_id")).alias("held_out"),
            "score",
            (F.col("score") >= threshold).cast("int").alias("predicted"),
            "offending",
        )
    )
