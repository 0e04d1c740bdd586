"""Documents whose other columns have the names that the pipeline uses inside."""

import corpus_pipeline

NAMES = "_id", "_digest", "_own", "MATCHED_0", "matched_1", "keep_id", "class_id", "key"


def test_stages_with_clashing_columns(spark):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words), (2, words.upper()), (3, words + " more"), (4, "another"), (None, None)]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)
    docs = spark.createDataFrame([(*r, *NAMES) for r in rows], schema)
    kept = corpus_pipeline.exact_dedup_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted(docs.filter("doc_id IS NULL OR doc_id <> 1").collect(), key=str)
    near = corpus_pipeline.jaccard_join_stage(spark, kept, "")
    assert near.columns == docs.columns
    found = {(r.doc_id, r.text) for r in near.collect()}
    # Words differ in upper and lower case, so the text in capitals is not near.
    assert found == {(2, words.upper()), (3, words + " more"), (4, "another"), (None, None)}
