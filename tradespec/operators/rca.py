"""Revealed comparative advantage (RCA): a local share over a baseline share.

The sums behind a share and the grand totals they are divided by come from one
aggregation. Totals are read back as a one-row subquery whose plan repeats the
aggregation unchanged, so Spark runs its shuffle once and reuses it. Two things
keep the plans equal: rows to drop are marked by an aggregate (``usable``), as a
filter on the grouping keys would be pushed below one of the two aggregations
only, and the totals row reads every aggregate, as an unread one would be pruned.
The row is attached as one struct column: an expression that repeated the
subquery would have Spark plan it as often as it occurs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.codes import zero_pad
from tradespec.functions.numbers import ratio_or_zero, sum_or_zero

WHOLE_SUM = "whole_value"
ENTITY_SUM = "entity_value"
USABLE = "usable"
TOTALS = "totals"


def entity_and_whole_sums(
    exports: DataFrame,
    entity: str = names.DEFAULT_STATE,
    by: tuple[str, ...] = (names.CODE,),
    pad: int | None = None,
    usable: Column | None = None,
) -> DataFrame:
    """Sums of the positive values per product, overall and for one entity.

    Both come out of the same aggregation: the entity's rows are part of the
    whole, so a second filtered scan and an outer join would find nothing more.
    A product without positive values keeps a row with null sums. Products that
    are not ``usable`` (by default those without a code) stay in for the totals.
    """
    if pad:
        exports = exports.withColumn(names.CODE, zero_pad(names.CODE, pad))
    if usable is None:
        usable = F.col(names.CODE).isNotNull()
    value = F.when(F.col(names.FOB) > 0, F.col(names.FOB))
    of_entity = F.when(F.col(names.STATE) == F.lit(entity), value)
    # `usable` first: a window over the sums moves it there, and the order of
    # the aggregates has to be the same in both plans.
    return exports.groupBy(*by).agg(
        F.max(usable).alias(USABLE),
        F.sum(value).alias(WHOLE_SUM),
        F.sum(of_entity).alias(ENTITY_SUM),
    )


def sum_totals(sums: DataFrame) -> Column:
    """Grand totals of :func:`entity_and_whole_sums` as a one-row subquery."""
    totals = F.struct(
        F.sum(WHOLE_SUM).alias("whole"),
        F.sum(ENTITY_SUM).alias("entity"),
        F.count_if(USABLE).alias("usable_groups"),
    )
    return sums.agg(totals.alias(TOTALS)).scalar()


def rca_of_sums() -> Column:
    """RCA from the sums of a product and the grand totals, given as columns.

    0 for a product the entity does not export. Null without a total to compare
    with, and for a product that nobody exports.
    """
    whole, entity = F.col(f"{TOTALS}.whole"), F.col(f"{TOTALS}.entity")
    known = whole.isNotNull() & entity.isNotNull() & F.col(WHOLE_SUM).isNotNull()
    local = F.coalesce(F.col(ENTITY_SUM), F.lit(0)) / entity
    return F.when(known, local / (F.col(WHOLE_SUM) / whole))


def entity_rca(
    exports: DataFrame,
    entity: str = names.DEFAULT_STATE,
    pad: int | None = None,
    name: str = names.ENTITY_RCA,
) -> DataFrame:
    """RCA of one entity against the whole table, per product.

    Only positive values count. No rows at all when either total is missing.
    """
    sums = entity_and_whole_sums(exports, entity, pad=pad)
    return (
        sums.where(F.col(USABLE))
        .withColumn(TOTALS, sum_totals(sums))
        .select(names.CODE, rca_of_sums().alias(name))
        .where(F.col(name).isNotNull())
    )


def selection_rca(selected: DataFrame, national: DataFrame) -> DataFrame:
    """RCA of each state within a selection, per product.

    The baseline is the whole national table when the selection holds a single
    state, otherwise the selection itself. Only positive RCAs are kept, except
    when the baseline adds up to zero: then every pair has RCA 0 and is kept.

    The windows run over aggregated rows: a state has one row per product, a
    product one per state and one per description.
    """
    of_state = Window.partitionBy(names.STATE)
    of_code = Window.partitionBy(names.CODE)
    state_missing = F.col(names.STATE).isNull()

    pairs = selected.groupBy(names.STATE, names.CODE).agg(
        sum_or_zero(names.FOB).alias(names.FOB),
        F.max(~state_missing & F.col(names.CODE).isNotNull()).alias(USABLE),
    )
    headings = national.groupBy(names.CODE, names.HEADING).agg(
        sum_or_zero(names.FOB).alias("heading_value")
    )

    # A missing state counts as one more state.
    states = F.count_distinct(names.STATE) + F.max(state_missing.cast("int"))
    facts = pairs.agg(
        F.struct(
            (states == 1).alias("one_state"),
            F.sum(names.FOB).alias("value"),
            F.count_if(USABLE).alias("usable_pairs"),
        ).alias("facts")
    ).scalar()
    national_value = headings.agg(F.sum("heading_value")).scalar()
    one_state = F.col("facts.one_state")

    local = (
        pairs.withColumns(
            {
                "state_value": F.sum(names.FOB).over(of_state),
                "selection_value": F.sum(names.FOB).over(of_code),
            }
        )
        .where(F.col(USABLE))
        .withColumns({"facts": facts, "national_total": national_value})
        .withColumn(
            "baseline_total",
            F.when(one_state, F.col("national_total")).otherwise(F.col("facts.value")),
        )
    )
    described = headings.select(
        F.col(names.CODE).alias("described_code"),
        names.HEADING,
        F.sum("heading_value").over(of_code).alias("national_value"),
    )
    # Null-safe, because a plain equality would push IS NOT NULL below the
    # aggregation and spoil the reuse.
    same_code = F.col(names.CODE).eqNullSafe(F.col("described_code"))
    joined = local.join(described, same_code, "left")

    product_value = F.when(
        one_state, F.coalesce("national_value", F.lit(0))
    ).otherwise(F.col("selection_value"))
    baseline_share = F.try_divide(product_value, F.col("baseline_total"))
    local_share = F.try_divide(F.col(names.FOB), F.col("state_value"))
    rca = F.when(baseline_share > 0, ratio_or_zero(local_share, baseline_share))
    return (
        joined.withColumn("VCR", F.coalesce(rca, F.lit(0.0)))
        .where((F.col("VCR") > 0) | (F.col("baseline_total") == 0))
        .select(names.STATE, names.CODE, names.HEADING, names.FOB, "VCR")
    )
