"""From landed files to the three input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradespec.operators.filters import equal_to, latest
from tradespec.sources.landed import read_dataset, read_payload_rows
from tradespec.sources.readers import read_trade_records
from tradespec.sources.schemas import COUNTRY_PRODUCT, EXPORTS
from tradespec.sources.sinks import write_csv
from tradespec.sources.tables import (
    COUNTRY_PRODUCT_FILE,
    EXPORTS_FILE,
    TRADE_RECORDS_FILE,
)

# The table of the data set and the classification that are used.
DATASET_TABLE = "hs92_country_product_year_4.csv"
CLASSIFICATION = "H4"


def landed_exports(spark: SparkSession, payloads: str) -> DataFrame:
    return read_payload_rows(spark, payloads, EXPORTS)


def landed_country_product(spark: SparkSession, folder: str) -> DataFrame:
    """Latest year of the country-product table, product codes kept as text."""
    table = read_dataset(
        spark,
        folder,
        DATASET_TABLE,
        {"product_hs92_code": T.StringType()},
        absent=COUNTRY_PRODUCT,
    )
    return latest(table)


def landed_trade_records(spark: SparkSession, path: str) -> DataFrame:
    return equal_to(
        read_trade_records(spark, path), "classificationCode", CLASSIFICATION
    )


def write_tables(
    exports: DataFrame,
    country_product: DataFrame,
    trade_records: DataFrame,
    folder: str,
    file_format: str = "csv",
) -> None:
    """Write the three tables where :class:`TradeTables` looks for them.

    As Parquet, exports are partitioned by year and records by reference year.
    """
    root = folder.rstrip("/")
    if file_format == "parquet":
        for table, name, by in (
            (exports, EXPORTS_FILE, "year"),
            (country_product, COUNTRY_PRODUCT_FILE, None),
            (trade_records, TRADE_RECORDS_FILE, "refYear"),
        ):
            path = f"{root}/{name.removesuffix('.csv')}"
            if by is None:
                table.write.parquet(path)
            else:
                # A year's rows meet in few tasks, so that it has few files.
                table.repartition(by, F.pmod(F.xxhash64(*table.columns), F.lit(8))).write.partitionBy(by).parquet(path)
        return
    if file_format != "csv":
        raise ValueError(f"csv or parquet, not {file_format!r}")
    write_csv(exports, f"{root}/{EXPORTS_FILE}")
    write_csv(country_product, f"{root}/{COUNTRY_PRODUCT_FILE}")
    write_csv(trade_records, f"{root}/{TRADE_RECORDS_FILE}")
