"""Documents to training sequences: five stages, each on what the one before kept."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradespec.llm import exact_dedup, jaccard_join, packing, quality, secrets
from tradespec.llm.common import documents, labels, texts_of, written
from tradespec.llm.queries import tokenizer_path
from tradespec.llm.shipping import shipped


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    shipped(spark)
    return quality.keep(docs, quality.train(docs, labels(spark, sf_dir)))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    kept = exact_dedup.content_sort(docs).filter("kept").select("doc_id", "text_sha256")
    return _matching(
        docs,
        kept,
        F.sha2(exact_dedup.ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), 256),
    )


def jaccard_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near duplicates, the document with the smallest id stays."""
    shipped(spark)
    classes = jaccard_join.linked_classes(docs)
    # A class is named by its smallest id, a document without an id by its text.
    named = texts_of(docs).select(
        "doc_id",
        F.sha2("text", 256).alias("_digest"),
        F.coalesce("doc_id", F.xxhash64(F.sha2("text", 256))).alias("_own"),
    )
    heads = classes.select(F.col("class_id").alias("_own")).distinct()
    kept = named.join(heads, "_own").select("doc_id", "_digest")
    return _matching(docs, kept, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    shipped(spark)
    masked = secrets.mask(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn(
            "n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)
        )
    return masked


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences."""
    return packing.pack(docs, tokenizer_path())


def _matching(docs: DataFrame, kept: DataFrame, digest: Column) -> DataFrame:
    """Rows of ``docs`` whose id and digest are those of ``kept``; rows repeated whole
    stay once."""
    names = docs.columns
    own, kept_id, kept_digest = _unused(names, 3)
    kept = written(kept.toDF(kept_id, kept_digest).distinct(), "kept")
    found = docs.withColumn(own, digest).join(
        kept,
        F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_digest)),
        "left_semi",
    )
    unique = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if not unique:
        found = found.dropDuplicates(["doc_id", own])
    return found.select(*names)


def _unused(names: list[str], count: int) -> list[str]:
    """Column names that a table does not have, whatever its upper and lower case."""
    taken = {n.lower() for n in names}
    free = (f"matched_{i}" for i in itertools.count())
    return list(itertools.islice((n for n in free if n not in taken), count))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", jaccard_join_stage),
    ("secret_scans", secrets_stage),
    ("best_fit_packing", packing_stage),
]

#: A trained classifier and a packing search are beyond SQL; the tests check each
#: stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
