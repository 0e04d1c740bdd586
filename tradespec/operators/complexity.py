"""Per-product means over the country-product-year table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.codes import code_prefix, zero_pad
from tradespec.functions.numbers import nan_to_null

# Result column -> input column.
METRICS = {
    names.COUNTRY_RCA: "export_rca",
    names.PCI: "pci",
    names.DISTANCE: "distance",
}


def heading_of(product_code: str, code_mode: str = "pad") -> Column:
    """Four-character heading of a product code: padded, or cut to a prefix."""
    if code_mode == "pad":
        return zero_pad(product_code, 4)
    if code_mode == "prefix":
        return code_prefix(product_code, 4)
    raise ValueError(f"code_mode is 'pad' or 'prefix', not {code_mode!r}")


def product_metrics(
    country_product: DataFrame,
    metrics: dict[str, str] | None = None,
    code_mode: str = "pad",
    country: str | None = None,
) -> DataFrame:
    """Mean of each metric per heading, all metrics in one aggregation.

    The means run over every country and year in the table unless ``country``
    narrows them to one.
    """
    if country is not None:
        country_product = country_product.where(F.col("country_iso3_code") == country)
    means = [
        F.avg(nan_to_null(source)).alias(name)
        for name, source in (metrics or METRICS).items()
    ]
    return (
        country_product.withColumn(
            names.CODE, heading_of("product_hs92_code", code_mode)
        )
        .where(F.col(names.CODE).isNotNull())
        .groupBy(names.CODE)
        .agg(*means)
    )


def country_rca(
    country_product: DataFrame, code_mode: str = "pad", country: str | None = None
) -> DataFrame:
    wanted = {names.COUNTRY_RCA: METRICS[names.COUNTRY_RCA]}
    return product_metrics(country_product, wanted, code_mode, country)


def complexity_and_distance(
    country_product: DataFrame, code_mode: str = "pad", country: str | None = None
) -> DataFrame:
    wanted = {name: METRICS[name] for name in (names.PCI, names.DISTANCE)}
    return product_metrics(country_product, wanted, code_mode, country)
