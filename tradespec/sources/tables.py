"""The three input tables together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradespec.sources import schemas
from tradespec.sources.readers import (
    read_country_product,
    read_exports,
    read_trade_records,
)

# Names of the three files in a data folder.
EXPORTS_FILE = "comexstat_data.csv"
COUNTRY_PRODUCT_FILE = "harvard_data.csv"
TRADE_RECORDS_FILE = "comtrade_data.csv"


@dataclass(frozen=True)
class TradeTables:
    exports: DataFrame
    country_product: DataFrame
    trade_records: DataFrame

    def consistent(self) -> TradeTables:
        """The same tables with years as integers, codes as text and the value as a
        double; a cell that does not fit becomes null, other columns stay."""

        def cast(df: DataFrame, **types: str) -> DataFrame:
            return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})

        return TradeTables(
            cast(self.exports, year="bigint", headingCode="string", metricFOB="double"),
            cast(
                self.country_product,
                year="bigint", product_hs92_code="string", country_iso3_code="string",
            ),
            cast(self.trade_records, refYear="bigint", cmdCode="string", reporterISO="string"),
        )

    @classmethod
    def load(cls, spark: SparkSession, folder: str, file_format: str = "csv") -> TradeTables:
        """Read all three; Spark raises ``AnalysisException`` if one is missing.

        ``file_format="parquet"`` reads what ``write_tables`` landed in that form:
        columns and years that a report does not need are then not read.
        """
        root = folder.rstrip("/")
        if file_format == "parquet":
            return cls(
                *(
                    # An empty partitioned table has no file that tells its schema.
                    spark.read.schema(schema).parquet(f"{root}/{name.removesuffix('.csv')}")
                    for name, schema in (
                        (EXPORTS_FILE, schemas.EXPORTS),
                        (COUNTRY_PRODUCT_FILE, schemas.COUNTRY_PRODUCT),
                        (TRADE_RECORDS_FILE, schemas.TRADE_RECORDS),
                    )
                )
            )
        if file_format != "csv":
            raise ValueError(f"csv or parquet, not {file_format!r}")
        return cls(
            exports=read_exports(spark, f"{root}/{EXPORTS_FILE}"),
            country_product=read_country_product(
                spark, f"{root}/{COUNTRY_PRODUCT_FILE}"
            ),
            trade_records=read_trade_records(spark, f"{root}/{TRADE_RECORDS_FILE}"),
        )
