"""Totals, means, shares and top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.money import money_text
from tradespec.functions.numbers import nan_to_null, sum_or_zero
from tradespec.operators.filters import Selection


def totals_by(df: DataFrame, keys: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """Sum of each value column per group; groups with a missing key are left out."""
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return df.where(present).groupBy(*keys).agg(*[sum_or_zero(v).alias(v) for v in values])


def exports_by_state(exports: DataFrame) -> DataFrame:
    return totals_by(exports, (names.STATE,), (names.FOB,))


def trade_by_year(country_product: DataFrame) -> DataFrame:
    return totals_by(country_product, (names.YEAR,), ("export_value", "import_value"))


def records_by_year(trade_records: DataFrame) -> DataFrame:
    return totals_by(trade_records, ("refYear",), ("primaryValue",))


def exports_by_code_and_year(exports: DataFrame) -> DataFrame:
    """Country-level sums with the number of state rows behind each."""
    return exports.groupBy(names.CODE, names.YEAR).agg(
        sum_or_zero(names.FOB).alias("total_metricFOB"),
        F.count("*").alias("state_records_count"),
    )


def add_share(df: DataFrame, value: str, name: str) -> DataFrame:
    """Add the share of each row in the column total (null when that is 0)."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name, F.try_divide(F.col(value), total))


def share_within(
    df: DataFrame, value: str, keys: tuple[str, ...], name: str
) -> DataFrame:
    """Add the share of each row in the total of its group.

    Meant for aggregated rows: a group has as many rows as it has members.
    """
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(name, F.try_divide(F.col(value), total))


def country_year_summary(country_product: DataFrame) -> DataFrame:
    """Two sums, five means and the number of products per country and year."""
    means = ("global_share", "export_rca", "distance", "cog", "pci")
    keys = ("country_iso3_code", names.YEAR)
    return (
        country_product.where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull())
        .groupBy(*keys)
        .agg(
            sum_or_zero("export_value").alias("export_value"),
            sum_or_zero("import_value").alias("import_value"),
            *[F.avg(nan_to_null(c)).alias(c) for c in means],
            F.count("product_id").alias("product_id"),
        )
    )


def product_exports(country_product: DataFrame) -> DataFrame:
    """Export total, mean complexity and share of the grand total per product."""
    per_product = (
        country_product.where(F.col("product_hs92_code").isNotNull())
        .groupBy("product_hs92_code")
        .agg(
            sum_or_zero("export_value").alias("total_export"),
            F.avg(nan_to_null("pci")).alias("average_pci"),
        )
    )
    # The subquery reads both aggregates so that it shares the shuffle above.
    grand = per_product.agg(
        F.struct(F.sum("total_export").alias("total"), F.count("average_pci"))
    ).scalar()
    return per_product.withColumn(
        "proportion", F.try_divide(F.col("total_export"), grand["total"])
    )


def top(df: DataFrame, by: str, tie: str, k: int = names.TOP_PRODUCTS) -> DataFrame:
    """The ``k`` highest rows. Each task keeps its own best ``k``; no full sort."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie)).limit(k)


def heading_shares(exports: DataFrame) -> DataFrame:
    """Value and share of the total per description and state."""
    per_pair = totals_by(exports, (names.HEADING, names.STATE), (names.FOB,))
    return add_share(per_pair, names.FOB, "percentage")


def lump_small(
    shares: DataFrame,
    threshold: float = names.SMALL_SHARE,
    value: str = names.FOB,
    share: str = "percentage",
) -> DataFrame:
    """Replace all rows whose share is under ``threshold`` by one row.

    The small rows are relabelled and summed by the same aggregation that
    passes the others through, so they are combined within each task before
    any of them moves. Without small rows there is no lumped row.
    """
    small = F.col(share) < threshold
    label = f"Demais/Outros (< {threshold * 100:.0f}%)"
    relabelled = shares.withColumns(
        {
            names.HEADING: F.when(small, F.lit(label)).otherwise(F.col(names.HEADING)),
            names.STATE: F.when(small, F.lit("Agregado")).otherwise(F.col(names.STATE)),
            "lumped": F.coalesce(small, F.lit(False)),
        }
    )
    # `lumped` keeps a real row that happens to carry the label apart.
    return (
        relabelled.groupBy(names.HEADING, names.STATE, "lumped")
        .agg(F.sum(value).alias(value), F.sum(share).alias(share))
        .drop("lumped")
    )


def number_of_states(exports: DataFrame) -> DataFrame:
    """One row: how many states there are, a missing state counting as one more,
    and whether it is a single one."""
    missing = F.coalesce(F.max(F.col(names.STATE).isNull().cast("int")), F.lit(0))
    states = F.count_distinct(names.STATE) + missing
    return exports.agg(states.alias("states"), (states == 1).alias("one_state"))


def value_by_description(trade_records: DataFrame) -> DataFrame:
    """Primary value and its share per product description."""
    per_text = totals_by(trade_records, ("cmdDesc",), ("primaryValue",))
    return add_share(per_text, "primaryValue", "share")


def headline_numbers(
    exports: DataFrame,
    selection: Selection,
    world_total: str = names.WORLD_TOTAL_TEXT,
) -> DataFrame:
    """One row: total of the selection, total of everything, both also as text,
    and the given world total."""

    def total(value: Column, name: str) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).alias(name)

    value = F.col(names.FOB)
    sums = exports.agg(
        total(F.when(selection.condition(exports), value), "selected_total"),
        total(value, "overall_total"),
    )
    return sums.select(
        "*",
        money_text("selected_total").alias("selected_text"),
        money_text("overall_total").alias("overall_text"),
        F.lit(world_total).alias("world_text"),
    )
