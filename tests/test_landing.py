"""Landed data sets and the Latin-1 sink, where something is wrong with them."""

import os

import pytest

from tradespec.operators import records
from tradespec.operators.filters import Selection
from tradespec.sources.landed import list_tables, read_dataset
from tradespec.sources.sinks import UnwritableText, write_stamped_latin1_csv


@pytest.fixture
def dataset(tmp_path):
    """Tables named like the folder they lie in, with blanks, nested, and beside other files."""
    root = tmp_path / "my data"
    for name in ("x.csv/my data/y.csv", "a b.csv", "z.csv/part-0.csv", "notes.txt"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("k,v\n1,2\n")
    return root


def test_tables_are_the_names_directly_below(spark, dataset):
    assert list_tables(spark, str(dataset)) == ["a b.csv", "x.csv", "z.csv"]
    assert list_tables(spark, f"{dataset}/") == ["a b.csv", "x.csv", "z.csv"]


def test_an_absent_target_is_an_empty_table(spark, dataset):
    assert read_dataset(spark, str(dataset), "z.csv").collect() == [(1, 2)]
    absent = read_dataset(spark, str(dataset), "absent.csv")
    assert absent.columns == [] and absent.count() == 0


def test_a_table_that_fails_leaves_the_others(spark, dataset):
    os.makedirs(dataset / "empty.csv")
    failed = {}
    tables = read_dataset(spark, str(dataset), failed=failed)
    assert {"a b.csv", "z.csv"} <= set(tables)
    assert "empty.csv" in failed and "empty.csv" not in tables
    with pytest.raises(Exception):
        read_dataset(spark, str(dataset))


def test_text_beyond_latin1_is_refused_and_named(spark, tmp_path):
    good = spark.createDataFrame([(1, "Ceará"), (2, None)], "k int, name string")
    path = write_stamped_latin1_csv(good, str(tmp_path))
    rows = spark.read.option("encoding", "ISO-8859-1").csv(path, header=True).collect()
    assert ("1", "Ceará") in map(tuple, rows)
    bad = good.union(spark.createDataFrame([(3, "日本 €")], good.schema))
    with pytest.raises(UnwritableText, match="name.*日本 €"):
        write_stamped_latin1_csv(bad, str(tmp_path / "other"))
    written = [name for _, _, names in os.walk(tmp_path / "other") for name in names]
    assert not [name for name in written if name == "_SUCCESS" or name.endswith(".csv")]


def test_selections_of_another_type_select_nothing_or_the_same(frame):
    rows = frame("state string, year long, headingCode string", ("23", 2020, "0101"), ("x", 2021, "0102"))
    assert Selection(states=(23,)).apply(rows).count() == 1
    assert Selection(years=("n.d.",)).apply(rows).count() == 0
    assert Selection(years=("2021",), products=("0102",)).apply(rows).count() == 1


def test_a_period_that_is_no_number_selects_nothing(frame):
    rows = frame("period long", (202301,), (202302,))
    assert rows.where(records._matches("period", "2023-01")).count() == 0
    assert rows.where(records._matches("period", "202301, n.d.")).count() == 1
