"""Comparison of products: RCAs, complexity, scenario and priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.numbers import round_half_even, to_number
from tradespec.operators.bridge import attach_codes
from tradespec.operators.complexity import product_metrics
from tradespec.operators.filters import code_between, in_list, valid_heading
from tradespec.operators.normalize import min_max
from tradespec.operators.priority import (
    Weights,
    adjusted_rca,
    linear_priority,
    nested_priority,
    ranked,
)
from tradespec.operators.rca import (
    ENTITY_SUM,
    TOTALS,
    USABLE,
    WHOLE_SUM,
    entity_and_whole_sums,
    rca_of_sums,
    sum_totals,
)
from tradespec.operators.scenarios import classify_scenarios


def headings_with_rca(
    exports: DataFrame,
    entity: str = names.DEFAULT_STATE,
    pad: int | None = 4,
    usable: Column | None = None,
) -> DataFrame:
    """Distinct (code, heading) with the RCA of the code, in one pass over exports.

    Sums are taken per (code, heading). The rows of a code are then just its
    descriptions, over which a window completes the sums of the code: the same
    rows a join of RCA and reference list would give, without a second scan.
    The RCA is null for a product nobody exports.
    """
    sums = entity_and_whole_sums(
        exports, entity, by=(names.CODE, names.HEADING), pad=pad, usable=usable
    )
    of_code = Window.partitionBy(names.CODE)
    per_code = sums.withColumns(
        {s: F.sum(s).over(of_code) for s in (WHOLE_SUM, ENTITY_SUM)}
    )
    return (
        per_code.where(F.col(USABLE))
        .withColumn(TOTALS, sum_totals(sums))
        .select(names.CODE, names.HEADING, rca_of_sums().alias(names.ENTITY_RCA))
    )


def comparison_table(
    exports: DataFrame,
    country_product: DataFrame,
    bridge: DataFrame | None = None,
    entity: str = names.DEFAULT_STATE,
    country: str | None = None,
    weights: Weights = Weights(),
) -> DataFrame:
    """One row per exported product with everything known about it.

    Missing metrics are set to 0 before classifying and normalizing, so they
    take part in both, and normalization covers all rows whatever a view
    filters out later. Descriptions that are missing stay null.
    """
    products = headings_with_rca(exports, entity).where(
        F.col(names.ENTITY_RCA).isNotNull()
    )
    metrics = product_metrics(country_product, country=country)
    filled = products.join(metrics, names.CODE, "left").na.fill(
        0.0, subset=list(names.COMPARISON_METRICS)
    )
    scored = linear_priority(min_max(filled, names.COMPARISON_METRICS), weights)
    return attach_codes(classify_scenarios(scored), bridge)


def comparison_view(
    table: DataFrame,
    first_code: str | None = None,
    last_code: str | None = None,
    scenarios: Sequence[str] = (),
) -> DataFrame:
    """The rows of a code range and of chosen scenarios, highest priority first."""
    rows = code_between(table, first_code, last_code)
    return ranked(rows.where(in_list(names.SCENARIO, scenarios)))


def with_headers(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """The columns of ``headers`` in that order, under their display names."""
    return df.select([F.col(c).alias(h) for c, h in headers.items()])


def legacy_comparison_table(
    exports: DataFrame,
    country_product: DataFrame,
    entity: str = names.DEFAULT_STATE,
    weights: Weights = Weights(),
) -> DataFrame:
    """The older comparison: all valid headings, nested index, 3 digits.

    It starts from the reference list, so products without exports are in it.
    Missing metrics stay missing and are skipped in the normalization bounds.
    """
    reference = headings_with_rca(
        exports, entity, pad=None, usable=valid_heading(names.CODE)
    )
    metrics = product_metrics(country_product, code_mode="prefix")
    table = adjusted_rca(reference.join(metrics, names.CODE, "left"))
    normalized = min_max(
        table,
        (*names.COMPARISON_METRICS, names.ADJUSTED_RCA),
        suffix="_NORM",
        coerce=True,
    )
    scored = nested_priority(normalized, weights)
    texts = (names.CODE, names.HEADING)
    numeric = [c for c in names.LEGACY_HEADERS if c not in texts]
    return scored.select(
        *texts, *[round_half_even(to_number(c)).alias(c) for c in numeric]
    )


def missing_as_text(df: DataFrame) -> DataFrame:
    """All columns as text, missing cells as ``names.MISSING_TEXT``."""
    missing = F.lit(names.MISSING_TEXT)
    return df.select(
        [F.coalesce(F.col(f"`{c}`").cast("string"), missing).alias(c) for c in df.columns]
    )


def legacy_view(table: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Ranked, with display names, missing cells as text.

    ``columns`` are the display names to show: ``names.LEGACY_NORMALIZED``,
    ``names.LEGACY_RAW``, or all. Sorting comes first: as soon as a column holds the text it is no number.
    """
    named = with_headers(ranked(table), names.LEGACY_HEADERS)
    return missing_as_text(named.select([F.col(f"`{c}`") for c in columns or named.columns]))
