"""Country-product table joined to trade records and national exports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tradespec import names
from tradespec.operators.filters import four_digit_codes
from tradespec.operators.joins import left_join_many, left_join_one
from tradespec.operators.summaries import exports_by_code_and_year


def three_source_table(
    country_product: DataFrame, trade_records: DataFrame, exports: DataFrame
) -> DataFrame:
    """Every country-product row with a 4-digit code, next to its trade records
    (one row for each) and the national export sum of its product and year."""
    products = four_digit_codes(country_product, "product_hs92_code")
    records = four_digit_codes(trade_records, "cmdCode")
    # The national sums go to the products before the records multiply the
    # rows: the keys are the products' own, and the large result of the record
    # join is then not shuffled again.
    with_sums = left_join_one(
        products,
        exports_by_code_and_year(exports),
        ("product_hs92_code", names.YEAR),
        (names.CODE, names.YEAR),
        "_comexstat",
    )
    joined = left_join_many(
        with_sums,
        records,
        ("product_hs92_code", names.YEAR, "country_iso3_code"),
        ("cmdCode", "refYear", "reporterISO"),
        "_comtrade",
    )
    sums = [c for c in with_sums.columns if c not in products.columns]
    others = [c for c in joined.columns if c not in sums]
    return joined.select(*others, *sums)
