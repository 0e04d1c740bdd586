"""Report on countries, years and products of the country-product table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.money import TIGHT_SUFFIXES, money_text
from tradespec.functions.numbers import percent_text, round_half_even
from tradespec.operators.filters import members
from tradespec.operators.summaries import (
    country_year_summary,
    product_exports,
    top,
)
from tradespec.plans.comparison import with_headers


def choose(
    country_product: DataFrame,
    years: Sequence[int] = (),
    countries: Sequence[str] = (),
    products: Sequence[str] = (),
) -> DataFrame:
    rows = members(country_product, names.YEAR, years)
    rows = members(rows, "country_iso3_code", countries)
    return members(rows, "product_hs92_code", products)


def country_summary(
    country_product: DataFrame,
    years: Sequence[int] = (),
    countries: Sequence[str] = (),
    products: Sequence[str] = (),
) -> DataFrame:
    """Display form of the summary per country and year."""
    chosen = choose(country_product, years, countries, products)
    money = ("export_value", "import_value")
    means = ("global_share", "export_rca", "distance", "cog", "pci")
    shown = country_year_summary(chosen).withColumns(
        {c: money_text(c, suffixes=TIGHT_SUFFIXES) for c in money}
        | {c: round_half_even(c) for c in means}
    )
    return with_headers(shown, names.COUNTRY_HEADERS)


def top_products(
    country_product: DataFrame,
    k: int = names.TOP_PRODUCTS,
    years: Sequence[int] = (),
    countries: Sequence[str] = (),
    products: Sequence[str] = (),
) -> DataFrame:
    """The ``k`` products with the highest export value.

    Shares are of the total over all chosen products, not over the ``k``.
    """
    chosen = choose(country_product, years, countries, products)
    best = top(product_exports(chosen), "total_export", "product_hs92_code", k)
    return best.withColumn("proportion_text", percent_text("proportion"))
