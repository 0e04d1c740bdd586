"""Toxicity: scores against the noisy-or spelled out, and held-out figures by size."""

import math
import pickle

import numpy as np
import pandas as pd
import pytest

from tradespec.llm import toxicity

DATA = "/root/testdata"


def spelled_out(text, weights, bias):
    """One minus the product of what the sentences leave, word by word."""
    left = 1.0
    for a, b in toxicity.sentence_spans(text):
        bag = {f for w in text[a:b].lower().split() for f in toxicity.features(w)}
        z = bias + sum(weights.get(f, 0.0) for f in bag)
        left *= 1 - 1 / (1 + math.exp(-z))
    return 1 - left


def test_scores_are_the_noisy_or_of_the_trained_model(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    marks = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    model = toxicity.train(docs, marks)
    weights, bias = pickle.loads(model)
    assert weights and bias <= toxicity.MOST_BIAS
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    found = toxicity.scores(docs, model).collect()
    assert len(found) == len(texts)
    for r in found:
        assert r.score == pytest.approx(spelled_out(texts[r.doc_id], weights, bias), abs=1e-9)
        assert r.predicted == (r.score >= 0.3)
    offending = [r for r in found if r.offending]
    assert offending
    for r in offending:
        for span in r.offending.split(","):
            a, b, p = span.split(":")
            assert spelled_out(texts[r.doc_id][int(a) : int(b)], weights, bias) == pytest.approx(
                float(p), abs=1e-3
            )


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_held_out_figures(spark, size):
    docs = spark.read.parquet(f"{DATA}/{size}/documents.parquet")
    marks = spark.read.parquet(f"{DATA}/{size}/labels.parquet")
    found = toxicity.scores(docs, toxicity.train(docs, marks)).filter("held_out")
    judged = found.join(marks, "doc_id").toPandas()
    toxic = judged.toxic == 1
    ranks, n = judged.score.rank(), toxic.sum()
    area = (ranks[toxic].sum() - n * (n + 1) / 2) / (n * (~toxic).sum())
    alarms = judged.predicted == 1
    print(size, "area", area, "precision", toxic[alarms].mean(), "recall", alarms[toxic].mean())
    assert area >= 0.95
    assert toxic[alarms].mean() >= 0.8 and alarms[toxic].mean() >= 0.85


def test_awkward_texts():
    long = "harmless words of a long text. " * 1000
    rows = [(i, f"word{i % 7} dreadful thing. other words", 1) for i in range(20)]
    rows += [(100 + i, f"word{i % 7} thing. other words", 0) for i in range(80)]
    scorer = toxicity.Scorer(toxicity.fit(pd.DataFrame(rows, columns=["doc_id", "text", "label"])))
    assert scorer.judge("") == (0.0, []) and scorer.judge(" \n\n ") == (0.0, [])
    assert scorer.judge(long)[0] < 0.2
    assert scorer.judge(long + "dreadful thing.")[0] > 0.5
    assert scorer.judge("Dreadful.") == scorer.judge("Dreadful.")


@pytest.mark.parametrize("labels", [[], [0] * 9, [1] * 9, [1, 1, 0, 0]])
def test_too_few_labels_give_no_weights(labels):
    rows = pd.DataFrame(
        {"doc_id": range(len(labels)), "text": ["a b c."] * len(labels), "label": labels}
    )
    weights, bias = pickle.loads(toxicity.fit(rows))
    assert weights == {} and bias == toxicity.MOST_BIAS
    assert np.isclose(toxicity.Scorer(b"").judge("a. b. c.")[0], 3 / (1 + math.exp(9)), rtol=1e-3)
