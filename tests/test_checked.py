"""Rejected cells of CSV tables, and payloads read as variants."""

import json

import pytest

from tests.helpers import explain
from tradespec.sources.checked import read_checked_csv
from tradespec.sources.landed import read_payload_rows
from tradespec.sources.readers import read_typed_csv

SCHEMA = "a bigint, b string, c double"
LINES = [
    "a,b,c", "1,x,2.5", "abc,y,1e400", "3,z", "4,w,1.0,5,6", '1e400,"q ""r""",zz', ",,", "7,v,1e400",
]


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "t.csv").write_text("\n".join(LINES) + "\n")
    return str(tmp_path)


def test_rejected_cells_are_listed_with_their_text(spark, folder):
    found = read_checked_csv(spark, folder, SCHEMA).rejects.collect()
    assert {(r.column, r.text, r.reason, r.record) for r in found} == {
        ("a", "abc", "unfit", "abc,y,1e400"),
        ("c", "1e400", "infinite", "abc,y,1e400"),
        (None, "5", "surplus", "4,w,1.0,5,6"),
        ("a", "1e400", "unfit", '1e400,"q ""r""",zz'),
        ("c", "zz", "unfit", '1e400,"q ""r""",zz'),
        ("c", "Infinity", "infinite", None),
    }


def test_the_table_is_that_of_the_lenient_reader(spark, folder):
    checked = read_checked_csv(spark, folder, SCHEMA).table
    lenient = read_typed_csv(spark, folder, SCHEMA)
    assert checked.schema == lenient.schema
    assert sorted(map(str, checked.collect())) == sorted(map(str, lenient.collect()))


def test_counts_come_with_the_first_action(spark, folder, tmp_path):
    checked = read_checked_csv(spark, folder, SCHEMA)
    assert explain(checked.table).count("Scan csv") == 2  # the tree's line and its detail
    checked.table.write.parquet(str(tmp_path / "out"))
    assert checked.counts.get == {"rows": 7, "rejected_rows": 4, "rejected_cells": 6}


def test_an_empty_table_and_a_taken_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n")
    checked = read_checked_csv(spark, str(tmp_path), SCHEMA)
    assert checked.table.count() == 0 and checked.rejects.count() == 0
    with pytest.raises(ValueError):
        read_checked_csv(spark, str(tmp_path), "__record string")


def test_payload_fields_beyond_the_schema_are_kept(spark, tmp_path):
    payloads = [
        {"data": {"list": [{"year": "2020", "x": 5.0, "more": {"a": [1, None]}}]}},
        {"data": [{"year": 2021, "x": "n.d.", "it's": None}]},
        {"data": None},
        {"other": 1},
    ]
    lines = [json.dumps(p) for p in payloads] + ["no json", "", '{"data":[{"year":1,"year":2}]}']
    (tmp_path / "p.json").write_text("\n".join(lines))
    rows = read_payload_rows(spark, str(tmp_path), "year bigint, x bigint, y string", unknown="rest")
    found = rows.selectExpr("year", "x", "y", "to_json(rest) AS rest").collect()
    assert sorted(map(tuple, found)) == [
        (2020, 5, None, '{"more":{"a":[1,null]}}'),
        (2021, None, None, '{"it\'s":null}'),
    ]
    plain = read_payload_rows(spark, str(tmp_path), "year bigint, x bigint, y string")
    assert plain.columns == ["year", "x", "y"]
    assert sorted(map(tuple, plain.collect())) == [(2020, 5, None), (2021, None, None)]


def test_a_payload_is_parsed_once(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"data":[{"year":1}]}')
    plan = explain(read_payload_rows(spark, str(tmp_path), "year bigint, state string"), "simple")
    assert plan.lower().count("parse_json") + plan.count("parseJson") == 1


def test_a_file_of_several_payloads(spark, tmp_path):
    (tmp_path / "p.json").write_text('[\n{"data":[{"year":1}]},\n{"data":{"list":[{"year":2}]}}]')
    rows = read_payload_rows(spark, str(tmp_path), "year bigint", multi_line=True)
    assert sorted(r.year for r in rows.collect()) == [1, 2]
