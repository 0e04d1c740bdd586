"""Links of the similarity join: shared and missing ids, large buckets, measured recall."""

import random

import pytest

from tradespec.llm import components as components_module
from tradespec.llm import jaccard_join
from tradespec.llm.common import written
from tradespec.llm.components import components


def grams(text, n=5):
    words = text.split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def linked(spark, rows):
    table = spark.createDataFrame(rows, "doc_id long, text string")
    return jaccard_join.linked_classes(table).collect()


def words(chance, count):
    return [f"w{chance.randrange(10**9)}" for _ in range(count)]


def test_two_texts_of_one_id_keep_their_links_apart(spark):
    chance = random.Random(1)
    a, b = (" ".join(words(chance, 60)) for _ in "ab")
    rows = [(1, a), (1, b), (2, a + " t"), (3, b + " t"), (9, "alone")]
    found = sorted((r.doc_id, r.class_id, r.n_links) for r in linked(spark, rows))
    assert found == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (9, 9, 0)]


def test_near_copies_without_ids_and_large_ids(spark):
    chance = random.Random(2)
    a, b = (" ".join(words(chance, 60)) for _ in "ab")
    rows = [(None, a), (None, a + " t"), (2**53 + 1, b), (2**53 + 3, b + " t"), (None, None)]
    found = linked(spark, rows)
    assert {r.doc_id for r in found} == {None, 2**53 + 1, 2**53 + 3}
    assert len({r.class_id for r in found if r.doc_id is None and r.n_links}) == 1
    assert {r.class_id for r in found if r.doc_id} == {2**53 + 1}
    assert sorted(r.n_links for r in found) == [0, 1, 1, 1, 1]


@pytest.fixture(scope="module")
def threshold_pairs():
    """Texts that share a passage, so that buckets are large, in pairs at 0.80 to 0.82."""
    chance = random.Random(3)
    passage = words(chance, 70)
    rows = []
    for i in range(240):
        own = passage + words(chance, 50)
        # Eight changed words in a row take 12 of 116 grams: 104 of 128 is 0.81.
        near = list(own)
        place = 72 + chance.randrange(8)
        for k in range(8):
            near[place + k] = f"n{chance.randrange(10**9)}"
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(near))]
    return rows


@pytest.mark.parametrize("strangers", [0, 512])
def test_recall_at_the_threshold_in_large_buckets(spark, threshold_pairs, monkeypatch, strangers):
    sets = {i: grams(t) for i, t in threshold_pairs}
    alike = [len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, 480, 2)]
    assert min(alike) >= 0.8 and max(alike) <= 0.82
    monkeypatch.setattr(jaccard_join, "BLOCK", 24)
    monkeypatch.setattr(jaccard_join, "STRANGERS", strangers)
    found = {r.doc_id: r for r in linked(spark, threshold_pairs)}
    caught = sum(found[i].class_id == found[i + 1].class_id == i for i in range(0, 480, 2))
    assert caught >= 0.99 * 240
    assert {r.n_links for r in found.values()} <= {0, 1}


def test_a_group_of_near_copies_in_one_bucket(spark, monkeypatch):
    """Every two of 150 copies agree, and three strangers hang on by one of them."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    chance = random.Random(4)
    text = words(chance, 120)
    rows = []
    for i in range(150):
        copy = list(text)
        copy[chance.randrange(120)] = f"c{i}"
        rows.append((i, " ".join(copy)))
    for i in range(3):
        rows.append((200 + i, rows[i][1] + " " + " ".join(words(chance, 20))))
    sets = {i: grams(t) for i, t in rows}

    def near(x, y):
        return len(x & y) >= 0.8 * len(x | y)

    wanted = {i: sum(near(x, y) for j, y in sets.items() if j != i) for i, x in sets.items()}
    found = {r.doc_id: r for r in linked(spark, rows)}
    assert {i: r.n_links for i, r in found.items()} == wanted
    assert {r.class_id for r in found.values()} == {0}


def test_components_of_random_graphs(spark):
    chance = random.Random(5)
    links = [(chance.randrange(400), chance.randrange(400)) for _ in range(260)]
    links += [(1000 + i, 1001 + i) for i in range(200)] + [(7, 7), (5000, 5000)]
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.v: r.component for r in found} == {v: root(v) for v in list(parent)}
    assert len(found) == len(parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_query_holds_the_links_of_all_splits(spark, threshold_pairs, monkeypatch):
    """The driver plans a few shuffles at a time, however often buckets are split."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 24)
    monkeypatch.setattr(jaccard_join, "STRANGERS", 3)
    shuffles, splits = [], []

    def counted(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles.append(plan.count("Exchange "))
        splits.append(name == "paths")
        return written(df, name)

    monkeypatch.setattr(jaccard_join, "written", counted)
    monkeypatch.setattr(components_module, "written", counted)
    found = {r.doc_id: r for r in linked(spark, threshold_pairs)}
    assert sum(found[i].class_id == found[i + 1].class_id == i for i in range(0, 480, 2)) >= 237
    assert sum(splits) > 4 and max(shuffles) <= 8
