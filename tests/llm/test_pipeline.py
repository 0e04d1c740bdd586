"""The pipeline's stages: what goes, what stays, and with which columns."""

import pytest

import corpus_pipeline
from tradespec.llm import quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_quality_stage_keeps_what_the_classifier_keeps(spark, docs):
    kept = corpus_pipeline.quality_stage(spark, docs, FOLDER)
    assert kept.schema == docs.schema
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = quality.scores(docs, quality.train(docs, labels)).filter("predicted = 1")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in found.collect()}


def test_exact_stage(spark, docs):
    kept = corpus_pipeline.exact_dedup_stage(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    best = {}
    for r in docs.collect():
        key = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)
        best[key] = max(best.get(key, -1), r.doc_id)
    assert {r.doc_id for r in kept.collect()} == set(best.values())


def test_near_stage_keeps_one_of_each_class(spark, frame):
    same = " ".join(f"w{i}" for i in range(90))
    rows = [(i, f"{same} tail{i}") for i in range(5)] + [(9, "on its own"), (10, None), (11, None)]
    kept = corpus_pipeline.jaccard_join_stage(spark, frame("doc_id long, text string", *rows), FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 9, 10]


def test_near_stage_without_ids(spark, frame):
    same = " ".join(f"w{i}" for i in range(90))
    rows = [(None, f"{same} tail{i}") for i in range(4)] + [(None, "on its own")]
    kept = corpus_pipeline.jaccard_join_stage(spark, frame("doc_id long, text string", *rows), FOLDER)
    assert kept.count() == 2


def test_secrets_are_masked(spark, docs):
    clean = corpus_pipeline.secrets_stage(spark, docs, FOLDER)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert not [r for r in clean.collect() if "AKIA" in r.text]


def test_awkward_rows_go_through(spark, awkward, nothing):
    for frame in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[1:-1]:
            assert stage(spark, frame, FOLDER).columns == frame.columns, name


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert 50 < rows.doc_id.nunique() <= 200
    assert rows.groupby("sequence_id").length.sum().max() <= 4096
