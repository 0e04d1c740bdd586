"""CSV readers.

The typed readers are lenient: a cell that does not fit its type becomes null,
surplus fields are dropped and missing ones are null, and the rest of the row
is kept. Names come from the schema, by position.

Quotes inside quoted cells are doubled. A quoted cell may hold a line break only
with ``multi_line``: such a file is read by one task, so land it as Parquet once
(:func:`tradespec.plans.ingest.write_tables`) and report from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradespec.sources import schemas

#: What reading and writing share: a quote within quotes is doubled.
QUOTING = {"quote": '"', "escape": '"'}


def read_typed_csv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> DataFrame:
    return spark.read.csv(
        path,
        schema=schema,
        header=True,
        mode="PERMISSIVE",
        encoding=encoding,
        multiLine=multi_line,
        **QUOTING,
    )


def read_exports(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_typed_csv(spark, path, schemas.EXPORTS, multi_line=multi_line)


def read_country_product(
    spark: SparkSession, path: str, multi_line: bool = False
) -> DataFrame:
    return read_typed_csv(spark, path, schemas.COUNTRY_PRODUCT, multi_line=multi_line)


def read_trade_records(
    spark: SparkSession, path: str, multi_line: bool = False
) -> DataFrame:
    return read_typed_csv(spark, path, schemas.TRADE_RECORDS, multi_line=multi_line)


def read_inferred_csv(
    spark: SparkSession,
    path: str,
    overrides: dict[str, T.DataType] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with inferred types, some columns forced to a given type.

    Overridden columns are *read* with their type. Casting after inference
    would be too late: a code inferred as a number has lost its leading zeros.
    Types are inferred from every row, which costs a pass over the files.
    """
    inferred = spark.read.csv(
        path, header=True, inferSchema=True, multiLine=multi_line, **QUOTING
    )
    if not overrides:
        return inferred
    unknown = sorted(set(overrides) - set(inferred.columns))
    if unknown:
        raise ValueError(f"no such columns to override: {unknown}")
    fields = [
        T.StructField(f.name, overrides.get(f.name, f.dataType), True)
        for f in inferred.schema.fields
    ]
    return read_typed_csv(spark, path, T.StructType(fields), multi_line=multi_line)


def read_bridge(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Product-to-activity correspondence: a title line, a header line, then rows.

    The first three columns are taken by position; further ones are ignored.
    CSV parts are read independently, so lines cannot be skipped by number:
    title and header are recognised by a product code that is not numeric.
    """
    rows = spark.read.csv(
        path,
        schema=schemas.BRIDGE,
        header=False,
        mode="PERMISSIVE",
        multiLine=multi_line,
        **QUOTING,
    )
    return rows.where(F.col("ncm8_raw").rlike(r"^[0-9]+(\.0)?$"))
