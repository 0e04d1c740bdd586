"""What the physical plans must look like, whatever the data size."""

import contextlib
import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import EXPORTS, explain
from tradespec import comparison_table, legacy_comparison_table, three_source_table
from tradespec.operators.filters import Selection, latest
from tradespec.operators.joins import left_join_many
from tradespec.operators.rca import entity_rca, selection_rca
from tradespec.operators.summaries import heading_shares, lump_small, product_exports, top
from tradespec.plans.comparison import comparison_view

COUNTRY = (
    "country_iso3_code string, product_hs92_code string, year long, export_value long, "
    "export_rca double, pci double, distance double"
)


def final_scans(df, table):
    """Scans of a table left in the executed plan and its subqueries."""
    df.collect()
    text = explain(df)
    trees = re.findall(r"== Final Plan ==\n(.*?)\+- == Initial Plan ==", text, re.S)
    scans = {n for tree in trees for n in re.findall(r"Scan parquet\s+\((\d+)\)", tree)}
    found = 0
    for n in scans:
        detail = re.search(rf"\n\({n}\) Scan parquet.*?\n\n", text, re.S).group(0)
        found += f"/{table}" in detail
    return found


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Tables on disk, so that plans start at file scans."""
    root = tmp_path_factory.mktemp("stored")
    exports = [
        (2020 + i % 4, f"S{i % 5}", f"{i % 30:04d}", f"h{i % 30}", i % 17) for i in range(600)
    ]
    countries = [
        (f"C{i % 6}", f"{i % 30:04d}", 2020 + i % 4, i, float(i % 7), float(i % 5), float(i % 3))
        for i in range(600)
    ]
    spark.createDataFrame(exports, EXPORTS).write.partitionBy("year").parquet(f"{root}/exports")
    spark.createDataFrame(countries, COUNTRY).write.parquet(f"{root}/countries")
    return {
        "exports": spark.read.parquet(f"{root}/exports"),
        "countries": spark.read.parquet(f"{root}/countries"),
    }


def test_rca_reads_its_table_once(stored):
    assert final_scans(entity_rca(stored["exports"], "S1"), "exports") == 1


def test_comparison_reads_each_table_once(stored):
    table = comparison_view(comparison_table(stored["exports"], stored["countries"], entity="S1"))
    assert final_scans(table, "exports") == 1
    assert final_scans(table, "countries") == 1


def test_legacy_comparison_reads_each_table_once(stored):
    table = legacy_comparison_table(stored["exports"], stored["countries"], entity="S1")
    assert final_scans(table, "exports") == 1
    assert final_scans(table, "countries") == 1


def test_selection_rca_reads_the_selection_and_the_whole_once(stored):
    exports = stored["exports"]
    chosen = Selection(states=("S1", "S2"), years=(2021,))
    assert final_scans(selection_rca(chosen.apply(exports), exports), "exports") == 2


def test_shares_read_their_table_once(stored):
    assert final_scans(lump_small(heading_shares(stored["exports"])), "exports") == 1
    assert final_scans(product_exports(stored["countries"]), "countries") == 1


def test_selections_reach_the_scan(stored):
    chosen = Selection(states=("S1", "S2"), years=(2021,), products=("0003",))
    plan = explain(chosen.apply(stored["exports"]).groupBy("state").agg(F.sum("metricFOB")))
    assert re.search(r"PartitionFilters: .*year#\d+ = 2021", plan)
    assert re.search(r"PushedFilters: .*In\(state, \[S1,S2\]\)", plan)
    assert re.search(r"PushedFilters: .*EqualTo\(headingCode,0003\)", plan)
    assert "ReadSchema: struct<state:string,headingCode:string,metricFOB:bigint>" in plan


def test_latest_year_prunes_partitions(stored):
    rows = latest(stored["exports"])
    plan = explain(rows)
    assert re.search(r"PartitionFilters: .*year#\d+ = Subquery", plan)


def test_top_products_need_no_full_sort(stored):
    plan = explain(top(product_exports(stored["countries"]), "total_export", "product_hs92_code"))
    assert "TakeOrderedAndProject" in plan


def test_the_three_source_table_reads_its_inputs_once(stored, spark, tmp_path):
    """The records are read once for the join and once, their keys alone, for the sketch."""
    path = str(tmp_path / "records")
    stored["exports"].select(
        F.col("headingCode").alias("cmdCode"),
        F.col("year").cast("long").alias("refYear"),
        F.regexp_replace("state", "S", "C").alias("reporterISO"),
        F.col("metricFOB").alias("primaryValue"),
    ).write.parquet(path)
    # As with tables too large to broadcast, and as with small ones.
    for threshold in ("-1", "10m"):
        with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": threshold}):
            records = spark.read.parquet(path)
            table = three_source_table(stored["countries"], records, stored["exports"])
            assert final_scans(table, "countries") == 1
            assert final_scans(table, "exports") == 1
            assert final_scans(table, "records") == 2


@contextlib.contextmanager
def settings(spark, **values):
    before = {key: spark.conf.get(key) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_third_of_the_records_under_one_key_is_split(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
        F.concat(F.lit("k"), F.col("id") % 97)
    )
    records = spark.range(0, 60000, numPartitions=8).select(key.alias("k"), "id")
    left = spark.range(0, 100).select(
        F.when(F.col("id") == 99, F.lit("hot"))
        .otherwise(F.concat(F.lit("k"), F.col("id")))
        .alias("key"),
        F.col("id").alias("n"),
    )
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.shuffle.partitions": "16",
    }
    with settings(spark, **small):
        joined = left_join_many(left, records, ("key",), ("k",), "_r", hot_rows=1000)
        rows = joined.collect()
    with settings(spark, **small, **{"spark.sql.adaptive.enabled": "false"}):
        joined = left_join_many(left, records, ("key",), ("k",), "_r", hot_rows=1000)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
    # The hot key alone has 20000 rows; it is dealt in parts of about 1000.
    assert max(r["count"] for r in sizes) < 8000
    assert len(rows) == 60000 + 2  # k97 and k98 have no records
    assert sum(r["key"] == "hot" for r in rows) == 20000
    assert sorted(r["key"] for r in rows if r["id"] is None) == ["k97", "k98"]


def test_the_part_of_a_right_row_is_not_worked_out_in_the_joins_below(spark, tmp_path):
    spark.range(300).selectExpr("id % 5 AS k", "id AS n").write.parquet(f"{tmp_path}/lines")
    spark.range(300).selectExpr("id AS m", "id % 3 AS o").write.parquet(f"{tmp_path}/orders")
    lines, orders = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("lines", "orders"))
    records = lines.join(orders, lines.n == orders.m).select(
        F.when(F.col("o") == 0, F.lit("hot")).otherwise(F.col("k").cast("string")).alias("lane"), "n"
    )
    left = spark.createDataFrame([("hot", 1), ("3", 2), ("9", 3)], "key string, id long")
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        joined = left_join_many(left, records, ("key",), ("lane",), "_r", hot_rows=10)
        plan = explain(joined)
        rows = [(r["id"], r["n"]) for r in joined.collect()]
    conditions = [x for x in plan.splitlines() if x.lower().startswith(("join condition", "condition"))]
    assert conditions
    assert not [x for x in conditions if "element_at" in x or "StructsToJson" in x]
    assert sorted(n for i, n in rows if i == 1) == list(range(0, 300, 3))
    assert sorted(n for i, n in rows if i == 2) == [n for n in range(300) if n % 3 and n % 5 == 3]
    assert [n for i, n in rows if i == 3] == [None]


def test_the_join_to_many_reads_each_side_once(spark, tmp_path):
    paths = {}
    for side in ("left", "right"):
        paths[side] = str(tmp_path / side)
        spark.range(3000).selectExpr("id % 50 AS k", "id AS n", "id AS m").write.parquet(paths[side])
    for threshold in ("-1", "10m"):
        with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": threshold}):
            left, right = (spark.read.parquet(paths[s]).alias(s) for s in ("left", "right"))
            joined = left_join_many(left, right, ("k",), ("k",), "_r")
            assert joined.count() == 3000 * 60
            assert final_scans(joined, "left") == 1
            # Beside the join, a sketch reads the key column of the right side alone.
            assert final_scans(joined, "right") == 2


def test_hot_keys_of_several_types_are_told_apart(spark):
    right = spark.createDataFrame(
        [("a", -0.0, i) for i in range(30)] + [("b", 1.0, 1), (None, 2.0, 3)] * 5,
        "k string, d double, n long",
    )
    left = spark.createDataFrame(
        [("a", 0.0, 1), ("a", 0.0, 2), ("b", 1.0, 3), ("c", 0.0, 4), (None, 2.0, 5)],
        "k string, d double, id long",
    )
    joined = left_join_many(left, right, ("k", "d"), ("k", "d"), "_r", hot_rows=4)
    assert joined.columns == ["k", "d", "id", "n"]
    rows = [(r.id, r.n) for r in joined.collect()]
    assert sorted(n for i, n in rows if i == 1) == list(range(30))
    assert sorted(n for i, n in rows if i == 2) == list(range(30))
    assert [n for i, n in rows if i == 3] == [1] * 5
    assert sorted(i for i, n in rows if n is None) == [4, 5]


def test_keys_of_different_types_join_by_the_rules_of_the_engine(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    right = spark.createDataFrame([(1, 10), (1, 11)], "k long, n long")
    joined = left_join_many(left, right, ("k",), ("k",), "_r", hot_rows=1)
    assert sorted(joined.collect(), key=str) == [(1, "x", 10), (1, "x", 11), (2, "y", None)]
