"""One query per operator with its production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradespec.llm import (
    alignment,
    bpe,
    exact_dedup,
    fingerprints,
    hard_negatives,
    html_extraction,
    jaccard_join,
    licenses,
    packing,
    quality,
    secrets,
    substring_dedup,
    toxicity,
)
from tradespec.llm.common import documents, labels
from tradespec.llm.oracle import ORACLE_SQL as ORACLE_SQL
from tradespec.llm.shipping import shipped

TOKENIZER = "word_bpe_49k.json"
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_against_next(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeated(documents(spark, sf_dir), with_text=False)
    return found.withColumnRenamed("kept", "kept_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.scores(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_classes(documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.scan(docs, licenses.train(docs))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), tokenizer_path())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scores(docs, quality.train(docs, labels(spark, sf_dir)))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_extraction.extract(pages, html_extraction.train(pages))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)
    return alignment.align(documents(spark, sf_dir), *files)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives.mine(hard_negatives.relabelled(vectors), F.col("vec_id") % 100 == 0)


def _on_executors(query: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(shipped(spark), sf_dir)

    return run


QUERIES = {
    query.__name__: _on_executors(query)
    for query in (
        op1_winnowing,
        op2_substring_dedup,
        op3_best_fit_packing,
        op4_toxicity,
        op5_jaccard_join,
        op6_secrets,
        op7_exact_dedup,
        op8_licenses,
        op9_bpe,
        op10_quality,
        op11_html_extraction,
        op12_alignment,
        op13_hard_negatives,
    )
}
