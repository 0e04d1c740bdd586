"""Hard negatives against brute force, and the packed products on their own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradespec.llm import hard_negatives
from tradespec.llm.hard_negatives import Packed, mine, relabelled

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, rid long"


def brute(rows):
    """The contract, row by row; rows are ``(vec_id, vector, label)``."""
    kept = [
        (k, i, [math.floor(256 * float(x)) for x in v], c)
        for k, (i, v, c) in enumerate(rows)
        if c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]

    def order(row):
        return -row[1], row[0][1] is None, row[0][1] or 0, row[0][0]

    out = []
    for a in kept:
        if a[1] is None or a[1] % 100:
            continue
        scored = [
            (o, sum(x * y for x, y in zip(a[2], o[2]))) for o in kept if o[0] != a[0] and len(o[2]) == len(a[2])
        ]
        scored.sort(key=order)
        for p, positive in [s for s in scored if s[0][3] == a[3]][:5]:
            band = [
                (o[1], score)
                for o, score in scored
                if o[3] != a[3] and 30 * positive <= 100 * score <= 90 * positive
            ]
            for rank, (i, score) in enumerate(band[:10], 1):
                out.append((a[1], p[1], rank, i, positive, score))
    return sorted(out, key=str)


def mined(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return sorted(map(tuple, mine(table, F.col("vec_id") % 100 == 0).collect()), key=str)


@pytest.fixture
def vectors():
    chance = np.random.default_rng(5)
    rows = []
    for i in range(260):
        # Few distinct components, so that scores tie.
        vector = (chance.integers(-3, 4, 6) / 4 + 0.25).tolist()
        rows.append((i, vector, int(chance.integers(0, 3))))
    return rows


def test_equals_brute_force(spark, vectors, monkeypatch):
    assert mined(spark, vectors) == brute(vectors) != []
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 1)
    assert mined(spark, vectors) == brute(vectors)


def test_rows_that_take_no_part_and_repeated_ones(spark, vectors):
    odd = vectors[:120] + [
        (200, None, 1),
        (300, [0.5, None, 0.1, 0.0, 0.0, 0.0], 1),
        (301, [math.nan] * 6, 1),
        (302, [math.inf] * 6, 1),
        (400, [0.5] * 6, None),
        (None, [0.5] * 6, 0),
        (None, [0.6] * 6, 1),
        (500, [], 0),
        (501, [], 1),
        (600, [0.5, 0.5], 0),
        (601, [0.6, 0.6], 0),
        (602, [0.3, 0.4], 1),
        vectors[0],
        vectors[100],
        vectors[100],
    ]
    found = mined(spark, odd)
    assert found == brute(odd)
    assert any(i is None for *_, i, _, _ in found)
    assert (600, 601, 1, 602, 2 * 128 * 153, 128 * (76 + 102)) in found
    assert mined(spark, []) == []


def test_one_label_with_a_third_of_the_rows(spark, vectors, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    rows = [(i, v, 0 if i % 3 == 0 else c + 1) for i, v, c in vectors]
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("largest", [1, 255, 4096, 1 << 20])
def test_packed_products_are_exact(largest):
    chance = np.random.default_rng(largest)
    rows = chance.integers(-largest, largest + 1, (33, 48))
    rows[0], rows[1] = largest, -largest
    for anchor in (rows[0], rows[1], rows[5], np.zeros(48, np.int64)):
        assert Packed(rows, largest).scores(anchor).tolist() == (rows @ anchor).tolist()


def test_labels_move_on(spark):
    rows = spark.createDataFrame([(7, 9), (8, 9), (14, 3), (0, None), (None, 2)], "vec_id long, label int")
    moved = {(r.vec_id, r.label) for r in relabelled(rows).collect()}
    assert moved == {(7, 0), (8, 9), (14, 4), (0, None), (None, 2)}
