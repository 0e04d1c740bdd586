"""Bounded training samples and the crc32 fold, for operators that learn from labels."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec.llm.common import is_held_out, texts_of


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of up to ``rows`` labelled rows outside the held-out fold.

    Rows are taken in the order of a hash of their id, which depends on nothing else.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .filter(~is_held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return texts_of(docs).join(F.broadcast(chosen), "doc_id")


def plain_sample(docs: DataFrame, rows: int) -> DataFrame:
    """``doc_id, text`` of up to ``rows`` rows outside the held-out fold, by hash of the id."""
    chosen = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        .filter(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return texts_of(docs).join(F.broadcast(chosen.distinct()), "doc_id")


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], bytes]) -> bytes:
    """The model that ``fit`` makes of a bounded sample, in one task of the cluster."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": [fit(rows.sort_values("doc_id", kind="stable"))]})

    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(run, "model binary").first()
    return bytes(found[0]) if found else b""
