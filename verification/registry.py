"""Every query that can be checked, by name: a callable (session, folder).

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradespec import names
from tradespec.functions import codes, money, numbers, periods
from tradespec.operators import (
    bridge,
    complexity,
    cube,
    filters,
    normalize,
    options,
    priority,
    rca,
    records,
    scenarios,
    summaries,
)
from tradespec.operators.joins import left_join_many, left_join_one
from tradespec.plans import (
    comparison,
    country,
    ingest,
    selection,
    three_source,
    trade_records,
)
from tradespec.sources import checked, landed, readers, schemas, sinks
from tradespec.sources.tables import TradeTables
from verification import shared
from verification import star_views as star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STATES = ("NATION_3", "NATION_7", "NATION_12")
YEARS = (1996, 1997, 1998)
#: Product codes of the records report.
RECORD_CODES = ("0011", "0023", "0034", "0042", "0105")
ONE_STATE = filters.Selection(states=(star.ENTITY,))
SEVERAL_STATES = filters.Selection(states=STATES, years=YEARS)


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def _single_of(column: Column | str) -> Column:
    return F.round(column, 12).cast("float").cast("double")


def _single(df: DataFrame, *columns: str) -> DataFrame:
    """Computed doubles are compared at single precision, see ``oracle``."""
    return df.withColumns({c: _single_of(c) for c in columns})


def _written(spark: SparkSession, df: DataFrame, name: str) -> str:
    path = f"{shared.new_path(spark, name)}/{name}.csv"
    sinks.write_csv(df, path)
    return path


def _all_record_columns(df: DataFrame) -> DataFrame:
    """Trade records widened to the columns and types of the file."""
    schema = T.StructType.fromDDL(schemas.TRADE_RECORDS)
    return df.select(
        [
            (F.col(f.name) if f.name in df.columns else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


# --- sources and sinks -----------------------------------------------------


@query("src1_exports_csv")
def _(spark, folder):
    return readers.read_exports(
        spark, _written(spark, star.exports(spark, folder), "exports")
    )


def _spoiled_exports(spark, folder):
    """The exports as a CSV file in which some years and values are no numbers."""
    value = F.col("metricFOB")
    spoiled = star.exports(spark, folder).select(
        F.when(value % 53 == 0, F.lit("n.d.")).otherwise(F.col("year").cast("string")).alias("year"),
        "state",
        "headingCode",
        "heading",
        F.when(value % 50 == 0, F.lit("abc"))
        .when(value % 50 == 1, F.lit("1e400"))
        .otherwise(value.cast("string"))
        .alias("metricFOB"),
    )
    path = _written(spark, spoiled, "spoiled")
    return checked.read_checked_csv(spark, path, schemas.EXPORTS)


@query("src1_rejected_cells")
def _(spark, folder):
    return _spoiled_exports(spark, folder).rejects.select("column", "text", "reason", "record")


@query("src1_reject_counts")
def _(spark, folder):
    """What writing the table tells of its rejects."""
    found = _spoiled_exports(spark, folder)
    found.table.write.parquet(shared.new_path(spark, "checked"))
    counts = found.counts.get
    names_ = ("rows", "rejected_rows", "rejected_cells")
    return spark.range(1).select(*[F.lit(counts[n]).cast("long").alias(n) for n in names_])


@query("src2_country_product_csv")
def _(spark, folder):
    path = _written(spark, star.country_product(spark, folder), "country_product")
    return readers.read_country_product(spark, path)


@query("src3_trade_records_csv")
def _(spark, folder):
    wide = _all_record_columns(star.trade_records(spark, folder))
    rows = readers.read_trade_records(spark, _written(spark, wide, "trade_records"))
    return rows.select(
        "typeCode", "refYear", "refMonth", "period", "reporterISO", "flowCode",
        "partnerCode", "classificationCode", "cmdCode", "cmdDesc", "isLeaf", "qty",
        "primaryValue",
    )


@query("src4_inferred_csv")
def _(spark, folder):
    """Without a schema the codes are numbers."""
    path = _written(spark, star.exports(spark, folder), "exports")
    rows = readers.read_inferred_csv(spark, path)
    return rows.select(
        F.col("year").cast("bigint"), "state", F.col("headingCode").cast("bigint"),
        "heading", F.col("metricFOB").cast("bigint"),
    )


@query("src5_inferred_csv_with_text_codes")
def _(spark, folder):
    path = _written(spark, star.country_product(spark, folder), "country_product")
    rows = readers.read_inferred_csv(
        spark, path, {"product_hs92_code": T.StringType()}
    )
    return rows.select(
        "country_iso3_code", "product_hs92_code", F.col("year").cast("bigint"),
        F.col("export_value").cast("bigint"),
    )


@query("src6_all_tables")
def _(spark, folder):
    root = shared.new_path(spark, "tables")
    ingest.write_tables(
        star.exports(spark, folder),
        star.country_product(spark, folder),
        _all_record_columns(star.trade_records(spark, folder)),
        root,
    )
    tables = TradeTables.load(spark, root)

    def described(name: str, df: DataFrame, value: str) -> DataFrame:
        return df.agg(
            F.lit(name).alias("name"),
            F.count("*").alias("n_rows"),
            F.sum(value).cast("bigint").alias("total"),
        )

    return (
        described("exports", tables.exports, "metricFOB")
        .unionByName(
            described("country_product", tables.country_product, "export_value")
        )
        .unionByName(described("trade_records", tables.trade_records, "primaryValue"))
    )


def _bridge_file(spark: SparkSession, folder: str, extra: tuple[str, ...] = ()) -> str:
    """The bridge as a file with a title line, a header line and quoted fields."""
    rows = star.bridge(spark, folder)

    def quoted(column: str) -> Column:
        return F.concat(F.lit('"'), F.col(column), F.lit('"'))

    fields = [quoted(c) for c in ("ncm8_raw", "ncm_descricao", "cnae_raw")]
    lines = rows.select(F.concat_ws(",", *fields, *map(F.lit, extra)).alias("value"))
    top_lines = spark.range(1).select(
        F.explode(F.array(F.lit("Correspondence table"), F.lit("NCM,DESC,CNAE"))).alias(
            "value"
        )
    )
    path = shared.new_path(spark, "bridge")
    top_lines.unionByName(lines).write.text(path)
    return path


@query("src7_bridge_csv")
def _(spark, folder):
    return readers.read_bridge(spark, _bridge_file(spark, folder))


@query("src8_bridge_first_three_columns")
def _(spark, folder):
    return readers.read_bridge(spark, _bridge_file(spark, folder, ("x", "y")))


@query("src9_payload_rows")
def _(spark, folder):
    """Half of the payloads keep their rows under ``data.list``, half in ``data``."""
    row = F.struct(*[F.col(c) for c in ("year", "state", "headingCode", "heading", "metricFOB")])
    exports = star.exports(spark, folder)
    listed = F.to_json(F.struct(F.struct(F.array(row).alias("list")).alias("data")))
    direct = F.to_json(F.struct(F.array(row).alias("data")))
    path = shared.new_path(spark, "payloads")
    exports.select(
        F.when(F.col("metricFOB") % 2 == 0, listed).otherwise(direct).alias("value")
    ).write.text(path)
    return ingest.landed_exports(spark, path)


@query("src9_unknown_fields")
def _(spark, folder):
    """Payloads with a field that the schema has not and without one that it has."""
    export = star.exports(spark, folder)
    row = F.struct(
        "year", "state", "metricFOB", F.struct(F.col("heading").alias("text")).alias("more")
    )
    path = shared.new_path(spark, "payloads")
    export.select(
        F.to_json(F.struct(F.struct(F.array(row).alias("list")).alias("data")))
    ).write.text(path)
    rows = landed.read_payload_rows(spark, path, schemas.EXPORTS, unknown="unknown")
    more = F.try_variant_get(F.col("unknown")["more"], "$.text", "string")
    return rows.withColumn("more", more).drop("unknown")


@query("src10_dataset_folder")
def _(spark, folder):
    """Latest year of the named table of a landed data set."""
    root = shared.new_path(spark, "dataset")
    table = star.country_product(spark, folder)
    sinks.write_csv(table, f"{root}/{ingest.DATASET_TABLE}")
    sinks.write_csv(table.select("country_id").distinct(), f"{root}/other.csv")
    rows = ingest.landed_country_product(spark, root)
    return rows.select(
        "country_iso3_code", "product_hs92_code", F.col("year").cast("bigint"),
        F.col("export_value").cast("bigint"),
    )


@query("src10_dataset_all_tables")
def _(spark, folder):
    root = shared.new_path(spark, "dataset")
    exports = star.exports(spark, folder)
    sinks.write_csv(exports, f"{root}/exports.csv")
    sinks.write_csv(exports.select("state").distinct(), f"{root}/states.csv")
    exports.select("heading").distinct().write.text(f"{root}/headings.txt")
    counts = [
        df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"))
        for name, df in landed.read_dataset(spark, root).items()
    ]
    first, *others = counts
    for other in others:
        first = first.unionByName(other)
    return first


@query("snk1_csv_written_and_read")
def _(spark, folder):
    wide = _all_record_columns(star.trade_records(spark, folder))
    rows = ingest.landed_trade_records(spark, _written(spark, wide, "records"))
    return rows.select(
        "refYear", "reporterISO", "classificationCode", "cmdCode", "primaryValue"
    )


@query("snk2_latin1_csv_written_and_read")
def _(spark, folder):
    table = star.exports(spark, folder).withColumn(
        "state", F.concat(F.lit("Ceará "), F.col("state"))
    )
    path = sinks.write_stamped_latin1_csv(table, shared.new_path(spark, "latin1"))
    return readers.read_typed_csv(spark, path, schemas.EXPORTS, encoding="ISO-8859-1")


# --- filters ---------------------------------------------------------------


@query("flt1_positive_values")
def _(spark, folder):
    shifted = star.exports(spark, folder).withColumn(
        "metricFOB", F.col("metricFOB") - 1000000
    )
    return filters.positive_values(shifted)


@query("flt2_one_entity")
def _(spark, folder):
    return filters.equal_to(star.exports(spark, folder), "state", star.ENTITY)


@query("flt3_latest_year")
def _(spark, folder):
    rows = filters.latest(star.country_product(spark, folder))
    return rows.select("country_iso3_code", "product_hs92_code", "year", "export_value")


@query("flt4_classification")
def _(spark, folder):
    rows = star.trade_records(spark, folder)
    return filters.equal_to(rows, "classificationCode", "H4").select(
        "reporterISO", "cmdCode", "classificationCode", "primaryValue"
    )


@query("flt5_membership")
def _(spark, folder):
    return SEVERAL_STATES.apply(star.exports(spark, folder))


@query("flt6_code_range")
def _(spark, folder):
    return filters.code_between(star.exports(spark, folder), "0010", "0020")


def _mixed_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Exports whose codes include unusable ones."""
    plain = F.col("headingCode").cast("int")
    code = (
        F.when(plain % 10 == 0, "0")
        .when(plain % 10 == 1, "7")
        .when(plain % 10 == 2, F.lit(None))
        .when(plain % 10 == 3, plain.cast("string"))
        .otherwise(F.col("headingCode"))
    )
    return star.exports(spark, folder).withColumn("headingCode", code)


@query("flt7_valid_headings")
def _(spark, folder):
    return filters.valid_headings(_mixed_codes(spark, folder))


@query("flt8_four_digit_codes")
def _(spark, folder):
    return filters.four_digit_codes(_mixed_codes(spark, folder), "headingCode")


@query("flt9_positive_rca")
def _(spark, folder):
    return _single(
        filters.positive_values(
            rca.entity_rca(star.exports(spark, folder), star.ENTITY), names.ENTITY_RCA
        ),
        names.ENTITY_RCA,
    )


@query("flt10_client_rows")
def _(spark, folder):
    """A client that sells every third product, for activities ending in 1."""
    pairs = bridge.product_activities(star.bridge(spark, folder))
    products = pairs.where(F.col("ncm8").cast("bigint") % 3 == 0).select("ncm8").distinct()
    activities = pairs.where(F.col("cnae7").endswith("1")).select("cnae7").distinct()
    return filters.client_rows(pairs, products, activities)


RECORDS = records.RecordFilter(
    period="1996,1997", partnerCode="1,2,3,4,5,6", reporterCode=None
)


@query("flt11_record_filter")
def _(spark, folder):
    rows = records.query_records(star.trade_records(spark, folder), RECORDS)
    return rows.select("period", "reporterISO", "partnerCode", "cmdCode", "motCode", "primaryValue")


# --- projections and option lists -------------------------------------------


@query("prj1_display_names")
def _(spark, folder):
    df = star.exports(spark, folder)
    headers = {c: h for c, h in names.SELECTION_HEADERS.items() if c in df.columns}
    return comparison.with_headers(df, headers)


@query("prj2_column_subset")
def _(spark, folder):
    return star.country_product(spark, folder).select(
        "year", "country_iso3_code", "product_hs92_code", "export_value"
    )


@query("prj3_heading_reference")
def _(spark, folder):
    return options.heading_reference(_mixed_codes(spark, folder))


@query("prj4_distinct_options")
def _(spark, folder):
    return options.distinct_options(star.exports(spark, folder), "state")


@query("prj4_distinct_years")
def _(spark, folder):
    return options.distinct_options(star.trade_records(spark, folder), "refYear", "int")


@query("prj5_default_option")
def _(spark, folder):
    rows = star.exports(spark, folder)
    found = options.default_option(rows, "state", star.ENTITY)
    absent = options.default_option(rows, "state", "no such state")
    return found.withColumn("preferred", F.lit(True)).unionByName(
        absent.withColumn("preferred", F.lit(False))
    )


@query("prj6_product_options")
def _(spark, folder):
    return options.product_options(star.exports(spark, folder), STATES, YEARS)


@query("prj7_code_from_label")
def _(spark, folder):
    labels = options.product_options(star.exports(spark, folder))
    return labels.withColumn("headingCode", codes.code_from_label("HS_Desc"))


@query("prj8_numbers_with_three_digits")
def _(spark, folder):
    rows = star.country_product(spark, folder)
    values = ("global_share", "export_rca", "distance", "cog", "pci")
    return rows.select(
        "year", "country_iso3_code", "product_hs92_code",
        *[numbers.round_half_even(numbers.to_number(c)).alias(c) for c in values],
    )


@query("prj9_missing_as_text")
def _(spark, folder):
    return comparison.missing_as_text(
        _mixed_codes(spark, folder).select("headingCode").distinct()
    )


@query("prj10_consistent_types")
def _(spark, folder):
    """Years that came as text, codes as numbers, some cells unfit; rows by year and code."""
    year_text = F.when(F.col("year") % 5 == 0, "n.d.").otherwise(F.col("year").cast("string"))
    exports, records = star.exports(spark, folder), star.trade_records(spark, folder)
    tables = TradeTables(
        exports.withColumns(
            {"year": year_text, "headingCode": F.col("headingCode").try_cast("bigint")}
        ),
        star.country_product(spark, folder).withColumn("year", year_text),
        records.withColumns(
            {
                "refYear": F.col("refYear").cast("string"),
                "cmdCode": F.col("cmdCode").try_cast("bigint"),
            }
        ),
    ).consistent()
    parts = (
        ("exports", tables.exports, "year", "headingCode"),
        ("country_product", tables.country_product, "year", "product_hs92_code"),
        ("trade_records", tables.trade_records, "refYear", "cmdCode"),
    )
    counted = [
        df.groupBy(F.col(year).alias("year"), F.col(code).alias("code"))
        .agg(F.count("*").alias("n_rows"))
        .select(F.lit(name).alias("source"), "year", "code", "n_rows")
        for name, df, year, code in parts
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


# --- joins -----------------------------------------------------------------


@query("jn1_entity_and_whole_sums")
def _(spark, folder):
    sums = rca.entity_and_whole_sums(star.exports(spark, folder), star.ENTITY)
    return sums.where(F.col(rca.USABLE)).select(
        "headingCode",
        F.coalesce(rca.ENTITY_SUM, F.lit(0)).alias(rca.ENTITY_SUM),
        F.coalesce(rca.WHOLE_SUM, F.lit(0)).alias(rca.WHOLE_SUM),
    )


@query("jn2_rca_joined_to_metrics")
def _(spark, folder):
    products = comparison.headings_with_rca(star.exports(spark, folder), star.ENTITY)
    metrics = complexity.product_metrics(star.country_product(spark, folder))
    return _single(
        products.join(metrics, names.CODE, "left"), *names.COMPARISON_METRICS
    )


@query("jn3_reference_joined_to_metrics")
def _(spark, folder):
    """Every valid heading, exported or not."""
    reference = comparison.headings_with_rca(
        _mixed_codes(spark, folder),
        star.ENTITY,
        pad=None,
        usable=filters.valid_heading(names.CODE),
    )
    metrics = complexity.product_metrics(
        star.country_product(spark, folder), code_mode="prefix"
    )
    return _single(
        reference.join(metrics, names.CODE, "left"), *names.COMPARISON_METRICS
    )


@query("jn4_attach_codes")
def _(spark, folder):
    products = star.exports(spark, folder).select("headingCode").distinct()
    return bridge.attach_codes(products, star.bridge(spark, folder))


@query("jn5_local_and_baseline_share")
def _(spark, folder):
    per_pair = summaries.totals_by(
        star.exports(spark, folder), ("state", "headingCode"), ("metricFOB",)
    )
    shares = summaries.share_within(per_pair, "metricFOB", ("state",), "local_share")
    baseline = summaries.add_share(
        summaries.totals_by(per_pair, ("headingCode",), ("metricFOB",)),
        "metricFOB",
        "baseline_share",
    ).drop("metricFOB")
    return _single(
        left_join_one(shares, baseline, ("headingCode",), ("headingCode",), "_base"),
        "local_share", "baseline_share",
    )


@query("jn6_attach_descriptions")
def _(spark, folder):
    products = comparison.headings_with_rca(star.exports(spark, folder), star.ENTITY)
    return _single(products, names.ENTITY_RCA)


@query("jn7_three_key_join")
def _(spark, folder):
    joined = left_join_many(
        star.country_product(spark, folder),
        star.trade_records(spark, folder),
        ("product_hs92_code", "year", "country_iso3_code"),
        ("cmdCode", "refYear", "reporterISO"),
        "_comtrade",
    )
    return joined.select(
        "product_hs92_code", "year", "country_iso3_code", "export_value", "flowCode",
        "partnerCode", "qty", "primaryValue",
    )


@query("jn7_hot_key_join")
def _(spark, folder):
    """A third of the records have one key, which is split; one product has no records."""
    records = star.trade_records(spark, folder).withColumn(
        "lane", F.when(F.col("refMonth") % 3 == 0, F.lit("0000")).otherwise(F.col("cmdCode"))
    )
    hot = F.col("id") == 0
    others = spark.range(2).select(
        F.when(hot, F.lit("0000")).otherwise(F.lit("9999")).alias("code"),
        F.lit(0).cast("long").alias("export_value"),
    )
    products = (
        star.country_product(spark, folder)
        .groupBy(F.col("product_hs92_code").alias("code"))
        .agg(F.sum("export_value").alias("export_value"))
        .unionByName(others)
    )
    joined = left_join_many(
        products, records, ("code",), ("lane",), "_comtrade", hot_rows=1000
    )
    return joined.select(
        "code", "export_value", "flowCode", "partnerCode", "qty", "primaryValue"
    )


@query("jn8_code_and_year_join")
def _(spark, folder):
    joined = left_join_one(
        star.country_product(spark, folder),
        summaries.exports_by_code_and_year(star.exports(spark, folder)),
        ("product_hs92_code", "year"),
        ("headingCode", "year"),
        "_comexstat",
    )
    return joined.select(
        "product_hs92_code", "year", "country_iso3_code", "export_value",
        "total_metricFOB", "state_records_count",
    )


@query("jn9_scalar_total")
def _(spark, folder):
    return _single(
        summaries.add_share(
            summaries.exports_by_state(star.exports(spark, folder)), "metricFOB", "share"
        ),
        "share",
    )


@query("jn10_semi_join")
def _(spark, folder):
    """Exports of headings that cheap parts have, as a list too long for IN."""
    cheap = star.bridge(spark, folder).where(F.col("ncm_descricao").startswith("small"))
    wanted = bridge.with_product_codes(cheap).select("sh4").distinct()
    return filters.members(star.exports(spark, folder), "headingCode", wanted)


# --- aggregations ----------------------------------------------------------


@query("ag1_sums_per_product")
def _(spark, folder):
    rows = star.exports(spark, folder)
    return summaries.totals_by(rows, ("headingCode",), ("metricFOB",))


@query("ag2_global_sums")
def _(spark, folder):
    rows = star.exports(spark, folder)
    nothing = rows.where(F.col("state") == "no such state")
    return rows.agg(numbers.sum_or_zero("metricFOB").alias("total")).unionByName(
        nothing.agg(numbers.sum_or_zero("metricFOB").alias("total"))
    )


@query("ag3_sums_per_state_and_product")
def _(spark, folder):
    rows = star.exports(spark, folder)
    return summaries.totals_by(rows, ("state", "headingCode"), ("metricFOB",))


@query("ag4_country_rca")
def _(spark, folder):
    rows = complexity.country_rca(star.country_product(spark, folder))
    return _single(rows, names.COUNTRY_RCA)


@query("ag4_country_rca_of_one_country")
def _(spark, folder):
    rows = complexity.country_rca(
        star.country_product(spark, folder), code_mode="prefix", country=star.COUNTRY
    )
    return _single(rows, names.COUNTRY_RCA)


@query("ag5_complexity_and_distance")
def _(spark, folder):
    rows = complexity.complexity_and_distance(star.country_product(spark, folder))
    return _single(rows, names.PCI, names.DISTANCE)


@query("ag6_country_year_summary")
def _(spark, folder):
    rows = summaries.country_year_summary(star.country_product(spark, folder))
    return _single(rows, "global_share", "export_rca", "distance", "cog", "pci")


@query("ag7_ag8_product_exports")
def _(spark, folder):
    rows = summaries.product_exports(star.country_product(spark, folder))
    return _single(rows, "average_pci", "proportion")


@query("ag9_heading_shares")
def _(spark, folder):
    return _single(summaries.heading_shares(star.exports(spark, folder)), "percentage")


@query("ag10_codes_per_heading")
def _(spark, folder):
    return bridge.codes_per_heading(star.bridge(spark, folder))


@query("ag11_value_by_description")
def _(spark, folder):
    return _single(
        summaries.value_by_description(star.trade_records(spark, folder)), "share"
    )


@query("ag12_exports_by_state")
def _(spark, folder):
    return summaries.exports_by_state(star.exports(spark, folder))


@query("ag13_trade_by_year")
def _(spark, folder):
    return summaries.trade_by_year(star.country_product(spark, folder))


@query("ag14_records_by_year")
def _(spark, folder):
    return summaries.records_by_year(star.trade_records(spark, folder))


@query("ag15_exports_by_code_and_year")
def _(spark, folder):
    return summaries.exports_by_code_and_year(star.exports(spark, folder))


@query("ag16_number_of_states")
def _(spark, folder):
    exports = star.exports(spark, folder)
    counted = [
        summaries.number_of_states(rows)
        for rows in (ONE_STATE.apply(exports), SEVERAL_STATES.apply(exports), exports)
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


CUBE = cube.CubeSpec(
    flow="export",
    period_from="1996-03",
    period_to="1998-10",
    filters={"state": STATES},
    details=("state", "heading"),
    metrics=("metricFOB", "metricKG", "metricCIF"),
)


@query("ag17_cube")
def _(spark, folder):
    return cube.cube_query(star.shipments(spark, folder), CUBE)


@query("ag17_cube_by_month")
def _(spark, folder):
    spec = cube.CubeSpec(
        flow="import",
        period_from="1995-01",
        period_to="1999-12",
        details=("state",),
        metrics=("metricFOB",),
        month_detail=True,
    )
    return cube.cube_query(star.shipments(spark, folder), spec)


@query("ag18_cube_by_city")
def _(spark, folder):
    spec = cube.CubeSpec.by_city(1997, star.ENTITY)
    return cube.cube_query(star.shipments(spark, folder), spec)


@query("ag19_count_only")
def _(spark, folder):
    spec = records.RecordFilter(
        period="1996,1997", partnerCode="1,2,3,4,5,6", countOnly=True
    )
    return records.query_records(star.trade_records(spark, folder), spec)


@query("ag20_aggregate_by")
def _(spark, folder):
    spec = records.RecordFilter(
        period=None, partnerCode=None, aggregateBy="reporterISO, refYear"
    )
    rows = records.query_records(star.trade_records(spark, folder), spec)
    return _single(rows, "netWgt", "qty")


# --- domain operators ------------------------------------------------------


@query("dom1_entity_rca")
def _(spark, folder):
    rows = rca.entity_rca(star.exports(spark, folder), star.ENTITY)
    return _single(rows, names.ENTITY_RCA)


@query("dom2_selection_rca_one_state")
def _(spark, folder):
    exports = star.exports(spark, folder)
    return _single(rca.selection_rca(ONE_STATE.apply(exports), exports), "VCR")


@query("dom2_selection_rca_several_states")
def _(spark, folder):
    exports = star.exports(spark, folder)
    return _single(rca.selection_rca(SEVERAL_STATES.apply(exports), exports), "VCR")


@query("dom3_zero_baseline")
def _(spark, folder):
    """Values that add up to zero: each line is there once more, negated."""
    exports = star.exports(spark, folder)
    sign = F.explode(F.array(F.lit(1), F.lit(-1))).alias("sign")
    balanced = exports.select("*", sign).withColumn(
        "metricFOB", F.col("metricFOB") * F.col("sign")
    )
    return rca.selection_rca(SEVERAL_STATES.apply(balanced), balanced)


@query("dom4_min_max")
def _(spark, folder):
    rows = complexity.product_metrics(star.country_product(spark, folder))
    columns = (names.COUNTRY_RCA, names.PCI, names.DISTANCE)
    scaled = normalize.min_max(rows, columns)
    return _single(scaled, *columns, *[f"{c}_norm" for c in columns])


@query("dom5_min_max_of_text")
def _(spark, folder):
    """Codes as text, every tenth not a number."""
    rows = _mixed_codes(spark, folder).groupBy("headingCode", "heading").agg(
        F.count("*").alias("n_rows")
    )
    mixed = rows.withColumn(
        "headingCode",
        F.when(F.col("headingCode") == "7", "seven").otherwise(F.col("headingCode")),
    )
    scaled = normalize.min_max(
        mixed, ("headingCode", "heading", "n_rows"), suffix="_NORM", coerce=True
    )
    return _single(scaled, "headingCode_NORM", "heading_NORM", "n_rows_NORM")


def _rca_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of RCAs spread widely enough to meet all seven scenarios."""
    rows = star.country_product(spark, folder)
    return rows.select(
        "country_iso3_code", "product_hs92_code", "year",
        (F.col("export_value") % 1301 / 500).alias(names.ENTITY_RCA),
        (F.col("import_value") % 1201 / 500).alias(names.COUNTRY_RCA),
    ).withColumn(
        names.COUNTRY_RCA,
        F.when(F.col(names.COUNTRY_RCA) > 2.3, F.lit(None))
        .when(F.col(names.COUNTRY_RCA) > 2.1, 0.0)
        .otherwise(F.col(names.COUNTRY_RCA)),
    )


@query("dom6_scenarios")
def _(spark, folder):
    return scenarios.classify_scenarios(_rca_pairs(spark, folder)).drop(
        names.SCENARIO_TEXT
    )


@query("dom7_scenario_texts")
def _(spark, folder):
    rows = scenarios.classify_scenarios(_rca_pairs(spark, folder))
    return rows.groupBy(names.SCENARIO, names.SCENARIO_TEXT).agg(
        F.count("*").alias("n_rows")
    )


def _normalized(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    products = comparison.headings_with_rca(star.exports(spark, folder), star.ENTITY)
    metrics = complexity.product_metrics(star.country_product(spark, folder))
    joined = products.join(metrics, names.CODE, "left")
    return normalize.min_max(joined, names.COMPARISON_METRICS, suffix)


@query("dom8_linear_priority")
def _(spark, folder):
    rows = priority.linear_priority(_normalized(spark, folder, "_norm"))
    kept = ("X", "Y", "Z", "AA", names.PRIORITY)
    return _single(rows, *kept).select(names.CODE, *kept)


@query("dom9_nested_priority")
def _(spark, folder):
    products = comparison.headings_with_rca(star.exports(spark, folder), star.ENTITY)
    metrics = complexity.product_metrics(star.country_product(spark, folder))
    table = priority.adjusted_rca(products.join(metrics, names.CODE, "left"))
    scaled = normalize.min_max(
        table, (*names.COMPARISON_METRICS, names.ADJUSTED_RCA), "_NORM", coerce=True
    )
    rows = priority.nested_priority(scaled)
    return _single(rows, names.PRIORITY).select(names.CODE, names.PRIORITY)


@query("dom10_nested_priority_two_rcas")
def _(spark, folder):
    weights = priority.Weights(entity=0.0, country=0.0)
    rows = priority.nested_priority(
        _normalized(spark, folder, "_NORM"), weights, use_adjusted=False
    )
    return _single(rows, names.PRIORITY).select(names.CODE, names.PRIORITY)


@query("dom11_adjusted_rca")
def _(spark, folder):
    products = comparison.headings_with_rca(star.exports(spark, folder), star.ENTITY)
    metrics = complexity.product_metrics(star.country_product(spark, folder))
    table = priority.adjusted_rca(products.join(metrics, names.CODE, "left"))
    scaled = normalize.min_max(table, (names.ADJUSTED_RCA,), "_NORM", coerce=True)
    kept = (names.ADJUSTED_RCA, f"{names.ADJUSTED_RCA}_NORM")
    return _single(scaled, *kept).select(names.CODE, *kept)


def _comparison(spark: SparkSession, folder: str, with_bridge: bool) -> DataFrame:
    return comparison.comparison_table(
        star.exports(spark, folder),
        star.country_product(spark, folder),
        star.bridge(spark, folder) if with_bridge else None,
        entity=star.ENTITY,
    )


@query("dom12_comparison_table")
def _(spark, folder):
    table = _comparison(spark, folder, with_bridge=True)
    doubles = [f.name for f in table.schema.fields if f.dataType == T.DoubleType()]
    return comparison.comparison_view(_single(table, *doubles))


@query("dom12_comparison_view")
def _(spark, folder):
    """Code range and two scenarios, under the display names."""
    table = _comparison(spark, folder, with_bridge=True)
    rows = comparison.comparison_view(table, "0005", "0045", ("Cenário 1", "Cenário 4"))
    shown = comparison.with_headers(rows, names.COMPARISON_HEADERS)
    return shown.withColumnsRenamed({"VCR Est.": "VCR Est", "VCR Nac.": "VCR Nac"}).select(
        "HS4", "Produto", "Cenário", "NCMs", "CNAE",
        *[_single_of(c).alias(c) for c in ("Prioridade", "VCR Est", "VCR Nac")],
    )


@query("dom13_legacy_comparison_table")
def _(spark, folder):
    return priority.ranked(
        comparison.legacy_comparison_table(
            star.exports(spark, folder),
            star.country_product(spark, folder),
            entity=star.ENTITY,
        )
    )


@query("dom14_legacy_comparison_mixed_codes")
def _(spark, folder):
    """The same over exports with unusable and unmatched codes."""
    return comparison.legacy_comparison_table(
        _mixed_codes(spark, folder),
        star.country_product(spark, folder),
        entity=star.ENTITY,
    )


@query("dom15_lump_small_shares")
def _(spark, folder):
    exports = filters.equal_to(star.exports(spark, folder), "state", star.ENTITY)
    return _single(summaries.lump_small(summaries.heading_shares(exports)), "percentage")


@query("dom15_lump_small_shares_all_states")
def _(spark, folder):
    shares = summaries.heading_shares(star.exports(spark, folder))
    return _single(summaries.lump_small(shares, 0.0002), "percentage")


@query("dom16_product_activities")
def _(spark, folder):
    return bridge.product_activities(star.bridge(spark, folder))


@query("dom17_bridge_rollup")
def _(spark, folder):
    return bridge.codes_per_heading(star.bridge(spark, folder))


@query("dom18_without_bridge")
def _(spark, folder):
    rows = _comparison(spark, folder, with_bridge=False)
    return rows.select(names.CODE, names.SCENARIO, "ncm8", "cnae_raw")


@query("dom19_headline_numbers")
def _(spark, folder):
    return summaries.headline_numbers(star.exports(spark, folder), SEVERAL_STATES)


@query("dom20_three_source_table")
def _(spark, folder):
    rows = three_source.three_source_table(
        star.country_product(spark, folder),
        star.trade_records(spark, folder),
        star.exports(spark, folder),
    )
    return rows.select(
        "product_hs92_code", "year", "country_iso3_code", "export_value", "flowCode",
        "partnerCode", "primaryValue", "total_metricFOB", "state_records_count",
    )


# --- reports, sorts, limits, sets -------------------------------------------


@query("srt1_ranked_by_priority")
def _(spark, folder):
    table = _comparison(spark, folder, with_bridge=False)
    return priority.ranked(table).select(
        names.CODE, _single_of(names.PRIORITY).alias(names.PRIORITY)
    )


@query("srt2_legacy_view")
def _(spark, folder):
    table = comparison.legacy_comparison_table(
        _mixed_codes(spark, folder),
        star.country_product(spark, folder),
        entity=star.ENTITY,
    )
    return comparison.legacy_view(table).select(
        "Código HS", "Descrição",
        (F.col("PCI (Bruto)") == names.MISSING_TEXT).alias("pci_missing"),
        (F.col("VCR país (Bruto)") == names.MISSING_TEXT).alias("rca_missing"),
    )


@query("srt3_selection_view")
def _(spark, folder):
    rows = selection.selection_table(star.exports(spark, folder), SEVERAL_STATES)
    return selection.selection_view(rows)


@query("srt4_selection_bars")
def _(spark, folder):
    return _single(
        selection.selection_bars(star.exports(spark, folder), ONE_STATE), "percentage"
    )


@query("top1_top_products")
def _(spark, folder):
    rows = country.top_products(star.country_product(spark, folder))
    return _single(rows, "average_pci", "proportion")


@query("lim1_first_rows")
def _(spark, folder):
    rows = star.exports(spark, folder)
    return rows.orderBy(*rows.columns).limit(5)


@query("set1_lumped_row_over_all_states")
def _(spark, folder):
    shares = summaries.heading_shares(star.exports(spark, folder))
    return _single(summaries.lump_small(shares, threshold=0.001), "percentage")


@query("set2_distinct_rows")
def _(spark, folder):
    return star.trade_records(spark, folder).select(
        "reporterISO", "cmdCode", "cmdDesc"
    ).distinct()


@query("trade_records_report_shares")
def _(spark, folder):
    report = trade_records.records_report(
        star.trade_records(spark, folder), years=YEARS, codes=RECORD_CODES
    )
    return _single(report["shares"], "share")


@query("trade_records_report_table")
def _(spark, folder):
    report = trade_records.records_report(star.trade_records(spark, folder), years=YEARS)
    return report["table"].select(
        "refYear", "cmdCode", "cmdDesc", "reporterISO", "flowCode", "partnerCode", "primaryValue"
    )


@query("country_summary_view")
def _(spark, folder):
    rows = country.country_summary(
        star.country_product(spark, folder), years=YEARS, countries=(star.COUNTRY, "N07")
    )
    return rows


# --- scalar functions -------------------------------------------------------


def _amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every line value at four magnitudes and once negative."""
    factor = F.explode(F.array(*map(F.lit, (0.01, 1.0, 1000.0, 1000000.0, -1.0))))
    return star.exports(spark, folder).select(
        "metricFOB", factor.alias("factor")
    ).withColumn("amount", F.col("metricFOB") * F.col("factor"))


@query("sc1_money_text")
def _(spark, folder):
    return _amounts(spark, folder).select(
        "metricFOB", "factor", money.money_text("amount").alias("text")
    )


@query("sc2_money_text_without_sign")
def _(spark, folder):
    return _amounts(spark, folder).select(
        "metricFOB", "factor", money.money_text("amount", prefix="").alias("text")
    )


@query("sc3_money_text_tight")
def _(spark, folder):
    text = money.money_text("amount", suffixes=money.TIGHT_SUFFIXES)
    return _amounts(spark, folder).select("metricFOB", "factor", text.alias("text"))


def _bridge_texts(name: str, **columns: Callable[[], Column]) -> None:
    @query(name)
    def _(spark, folder):
        rows = star.bridge(spark, folder)
        return rows.select("ncm8_raw", *[c().alias(n) for n, c in columns.items()])


_bridge_texts(
    "sc4_zero_pad",
    padded=lambda: codes.zero_pad(F.substring("ncm8_raw", 3, 3), 8),
    kept=lambda: codes.zero_pad("ncm8_raw", 4),
)
_bridge_texts("sc5_prefix", prefix=lambda: codes.code_prefix("ncm8_raw", 4))
_bridge_texts("sc6_strip_decimals", code=lambda: codes.strip_decimal_suffix("ncm8_raw"))
_bridge_texts("sc7_strip_marks", code=lambda: codes.strip_code_marks("cnae_raw"))
_bridge_texts("sc8_split_and_explode", part=lambda: F.explode(F.split("cnae_raw", ";")))
_bridge_texts("sc9_all_digits", digits=lambda: codes.all_digits("ncm8_raw"))
_bridge_texts("sc10_length", size=lambda: F.length("ncm8_raw").cast("bigint"))
_bridge_texts(
    "sc11_concatenate",
    label=lambda: codes.option_label("ncm8_raw", "ncm_descricao"),
    joined=lambda: F.concat_ws(", ", "ncm8_raw", "ncm_descricao"),
)


_bridge_texts(
    "sc12_to_number",
    product=lambda: numbers.to_number("ncm8_raw"),
    activity=lambda: numbers.to_number("cnae_raw"),
    whole=lambda: F.col("ncm8_raw").try_cast("double").cast("bigint"),
)


@query("sc13_guarded_division")
def _(spark, folder):
    rows = star.exports(spark, folder)
    divisor = F.col("metricFOB") % 7
    return rows.select(
        "metricFOB", _single_of(numbers.ratio_or_zero("metricFOB", divisor)).alias("ratio")
    )


@query("sc14_round_and_percent")
def _(spark, folder):
    rows = summaries.heading_shares(star.exports(spark, folder))
    return rows.select(
        "heading", "state",
        numbers.round_half_even("percentage").alias("rounded"),
        numbers.percent_text("percentage").alias("text"),
    )


@query("sc15_fill_missing")
def _(spark, folder):
    rows = _mixed_codes(spark, folder).select(
        "metricFOB", numbers.to_number("headingCode").alias("number")
    )
    return rows.na.fill(0.0, subset=["number"])


@query("sc16_year_bounds")
def _(spark, folder):
    years = star.exports(spark, folder).select("year").distinct()
    first, last = periods.year_bound_columns("year")
    return years.select("year", first.alias("first"), last.alias("last"))
