"""The trade tables, read off a star schema of orders and line items.

They give the queries realistic inputs: a supplier's nation plays the state or
the exporting country, the part size the product heading, the customer's nation
the importing country. Money is in whole cents, so sums are exact.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY = "NATION_3"
COUNTRY = "N03"


@lru_cache(maxsize=None)
def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table of a folder; its files are listed and its footer read only once."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(column: str) -> Column:
    """Amounts have two decimals, so this only undoes the binary error. Unlike
    ``round``, ``rint`` does not go through a decimal for every row."""
    return F.rint(F.col(column) * 100).cast("bigint")


def _heading_code() -> Column:
    return F.lpad(F.col("p_size").cast("string"), 4, "0")


def _country_code(key: str) -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col(key).cast("string"), 2, "0"))


def _year(column: str = "l_shipdate") -> Column:
    return F.year(column).cast("bigint")


def _sold_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the supplier and the part."""
    lines = _table(spark, folder, "lineitem")
    supplier = _table(spark, folder, "supplier")
    part = _table(spark, folder, "part")
    return lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(
        part, lines.l_partkey == part.p_partkey
    )


def _traded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The same with the customer who ordered."""
    orders = _table(spark, folder, "orders")
    customer = _table(spark, folder, "customer")
    buyers = orders.join(customer, orders.o_custkey == customer.c_custkey)
    sold = _sold_lines(spark, folder)
    return sold.join(buyers, sold.l_orderkey == buyers.o_orderkey)


def exports(spark: SparkSession, folder: str) -> DataFrame:
    nation = _table(spark, folder, "nation")
    sold = _sold_lines(spark, folder)
    return sold.join(nation, sold.s_nationkey == nation.n_nationkey).select(
        _year().alias("year"),
        F.col("n_name").alias("state"),
        _heading_code().alias("headingCode"),
        F.concat(F.lit("Heading "), _heading_code()).alias("heading"),
        _cents("l_extendedprice").alias("metricFOB"),
    )


def country_product(spark: SparkSession, folder: str) -> DataFrame:
    """Export and import side of every line in one aggregation.

    Each line counts once for the exporting and once for the importing country,
    so the joined lines are aggregated a single time. What is left has at most
    one row per year, nation and heading (25 nations, 50 headings): the windows
    for the totals run over that.
    """
    lines = _traded_lines(spark, folder).select(
        _year().alias("year"),
        _heading_code().alias("code"),
        F.col("s_nationkey").alias("seller"),
        F.col("c_nationkey").alias("buyer"),
        _cents("l_extendedprice").alias("value"),
        _cents("l_discount").alias("discount"),
        _cents("l_tax").alias("tax"),
        _cents("p_retailprice").alias("retail"),
    )
    exporting = F.col("side") == "export"
    sides = lines.withColumn(
        "side", F.explode(F.array(F.lit("export"), F.lit("import")))
    ).select(
        "year",
        "code",
        F.when(exporting, F.col("seller")).otherwise(F.col("buyer")).alias("country"),
        F.when(exporting, F.col("value")).alias("sold"),
        F.when(~exporting, F.col("value")).alias("bought"),
        *[F.when(exporting, F.col(c)).alias(c) for c in ("discount", "tax", "retail")],
    )
    cells = (
        sides.groupBy("year", "code", "country")
        .agg(
            F.sum("sold").alias("sold"),
            F.coalesce(F.sum("bought"), F.lit(0)).alias("bought"),
            F.sum("discount").alias("discount"),
            F.sum("tax").alias("tax"),
            F.sum("retail").alias("retail"),
            F.count("sold").alias("lines"),
        )
        .where("lines > 0")
    )

    def total(*keys: str) -> Column:
        return F.sum("sold").over(Window.partitionBy(*keys))

    totals = cells.withColumns(
        {
            "of_country": total("year", "country"),
            "of_product": total("year", "code"),
            "of_year": total("year"),
        }
    )
    return totals.select(
        F.col("country").alias("country_id"),
        _country_code("country").alias("country_iso3_code"),
        F.col("code").cast("bigint").alias("product_id"),
        F.col("code").alias("product_hs92_code"),
        "year",
        F.col("sold").alias("export_value"),
        F.col("bought").alias("import_value"),
        (F.col("sold") / F.col("of_product")).alias("global_share"),
        (
            (F.col("sold") / F.col("of_country"))
            / (F.col("of_product") / F.col("of_year"))
        ).alias("export_rca"),
        (F.col("discount") / F.col("lines") / 10).alias("distance"),
        (F.col("tax") / F.col("lines") / 10).alias("cog"),
        (F.col("retail") / F.col("lines") / 100000 - 1).alias("pci"),
    )


def trade_records(spark: SparkSession, folder: str) -> DataFrame:
    return _traded_lines(spark, folder).select(
        F.lit("C").alias("typeCode"),
        F.lit("A").alias("freqCode"),
        _year().alias("refYear"),
        F.month("l_shipdate").cast("bigint").alias("refMonth"),
        _year().alias("period"),
        F.col("s_nationkey").cast("string").alias("reporterCode"),
        _country_code("s_nationkey").alias("reporterISO"),
        F.when(F.col("l_returnflag") == "R", "M").otherwise("X").alias("flowCode"),
        F.col("c_nationkey").cast("string").alias("partnerCode"),
        F.when(F.col("l_linestatus") == "F", "H4").otherwise("H5").alias("classificationCode"),
        F.lit("HS").alias("classificationSearchCode"),
        _heading_code().alias("cmdCode"),
        F.col("p_type").alias("cmdDesc"),
        F.lit("C00").alias("customsCode"),
        F.col("l_linenumber").cast("string").alias("motCode"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_quantity") * 2).alias("netWgt"),
        _cents("l_extendedprice").alias("primaryValue"),
    )


def bridge(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("p_partkey")
    number = F.concat(_heading_code(), F.lpad((key % 10000).cast("string"), 4, "0"))
    activities = F.concat(
        _heading_code(),
        F.lit("."),
        (key % 7).cast("string"),
        F.lit("; "),
        F.lpad(F.regexp_replace("p_brand", "Brand#", ""), 4, "0"),
        F.lit("-1"),
    )
    return _table(spark, folder, "part").select(
        F.concat(number, F.when(key % 3 == 0, ".0").otherwise("")).alias("ncm8_raw"),
        F.col("p_name").alias("ncm_descricao"),
        F.when(key % 11 == 0, "XXXX").otherwise(activities).alias("cnae_raw"),
    )


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    nation = _table(spark, folder, "nation")
    sold = _sold_lines(spark, folder)
    fob = _cents("l_extendedprice")
    return sold.join(nation, sold.s_nationkey == nation.n_nationkey).select(
        F.when(F.col("l_returnflag") == "R", "import").otherwise("export").alias("flow"),
        _year().alias("year"),
        F.month("l_shipdate").cast("bigint").alias("month"),
        F.col("n_name").alias("state"),
        F.col("s_name").alias("city"),
        F.concat(F.lit("Heading "), _heading_code()).alias("heading"),
        fob.alias("metricFOB"),
        F.col("l_quantity").cast("bigint").alias("metricKG"),
        (fob + _cents("l_tax")).alias("metricCIF"),
    )
