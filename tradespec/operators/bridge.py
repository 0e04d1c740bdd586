"""Correspondence between product codes and activity codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.codes import (
    all_digits,
    code_prefix,
    strip_code_marks,
    strip_decimal_suffix,
    zero_pad,
)


def with_product_codes(bridge: DataFrame, heading: str = "sh4") -> DataFrame:
    """Add the 8-digit product code and its 4-digit heading."""
    return bridge.withColumn(
        "ncm8", zero_pad(strip_decimal_suffix("ncm8_raw"), 8)
    ).withColumn(heading, code_prefix("ncm8", 4))


def product_activities(bridge: DataFrame) -> DataFrame:
    """One row per product and activity code, without the activities that are no
    numbers and the rows without a product code."""
    activity = F.explode(F.split("cnae_raw", ";"))
    return (
        with_product_codes(bridge)
        .select("ncm8", "sh4", "ncm_descricao", activity.alias("activity"))
        .select("ncm8", "sh4", "ncm_descricao", strip_code_marks("activity").alias("cnae7"))
        .where(all_digits("cnae7") & F.col("ncm8").isNotNull())
    )


def codes_per_heading(bridge: DataFrame) -> DataFrame:
    """Distinct product codes and activity texts of each heading, sorted and
    joined by ``", "``.

    Duplicates go first, in an aggregation spread over all (heading, text)
    pairs; only the distinct texts that make up a result cell meet in one task.
    """
    coded = with_product_codes(bridge, heading=names.CODE)
    listed = F.when(F.lower("cnae_raw") != "nan", F.col("cnae_raw"))
    texts = F.array(
        F.struct(F.lit("ncm8").alias("kind"), F.col("ncm8").alias("text")),
        F.struct(F.lit("cnae_raw").alias("kind"), listed.alias("text")),
    )
    distinct_texts = (
        coded.where(F.col(names.CODE).isNotNull())
        .select(names.CODE, F.explode(texts).alias("entry"))
        .select(names.CODE, "entry.kind", "entry.text")
        .where(F.col("text").isNotNull())
        .distinct()
    )

    def joined(kind: str):
        found = F.collect_list(F.when(F.col("kind") == kind, F.col("text")))
        return F.concat_ws(", ", F.sort_array(found)).alias(kind)

    return distinct_texts.groupBy(names.CODE).agg(joined("ncm8"), joined("cnae_raw"))


def attach_codes(table: DataFrame, bridge: DataFrame | None) -> DataFrame:
    """Add the correspondence columns; a fixed text in both without a bridge."""
    if bridge is None:
        missing = F.lit(names.NOT_AVAILABLE)
        return table.withColumns({"ncm8": missing, "cnae_raw": missing})
    return table.join(codes_per_heading(bridge), names.CODE, "left")
