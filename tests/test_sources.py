from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from tests.helpers import EXPORTS, as_set
from tradespec.plans import ingest
from tradespec.sources import landed, readers, schemas, sinks
from verification import shared
from tradespec.sources.tables import TradeTables


def write(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding=encoding)
    return str(path)


def test_lenient_exports(spark, tmp_path):
    path = write(
        tmp_path / "e.csv",
        "year,state,headingCode,heading,metricFOB\n"
        "2023,Ceará,0101,\"Horses, live\",10\n"
        "bad,Bahia,0102,Cattle,20\n"
        "2023,Bahia,0103,Swine,1e9x\n"
        "2023,Bahia,0104,Sheep,30,surplus,fields\n"
        "2023,Bahia\n"
        "2023,,0105,,99999999999\n",
    )
    rows = [tuple(r) for r in readers.read_exports(spark, path).collect()]
    assert rows == [
        (2023, "Ceará", "0101", "Horses, live", 10),
        (None, "Bahia", "0102", "Cattle", 20),
        (2023, "Bahia", "0103", "Swine", None),
        (2023, "Bahia", "0104", "Sheep", 30),
        (2023, "Bahia", None, None, None),
        (2023, None, "0105", None, 99999999999),
    ]


def test_country_ids_and_periods_above_small_integer_ranges(spark, tmp_path):
    path = write(
        tmp_path / "c.csv",
        "a,b,c,d,e,f,g,h,i,j,k,l\n842,USA,650,0101,2023,1,2,0.5,1.5,0.9,0.1,-1.25\n",
    )
    row = readers.read_country_product(spark, path).collect()[0]
    assert (row["country_id"], row["product_hs92_code"], row["pci"]) == (842, "0101", -1.25)

    columns = [f.name for f in T.StructType.fromDDL(schemas.TRADE_RECORDS).fields]
    assert len(columns) == 47
    values = {"refPeriodId": "20230101", "cmdCode": "0101", "isLeaf": "True", "qty": "1.5", "aggrLevel": "4"}
    line = ",".join(values.get(c, "") for c in columns)
    path = write(tmp_path / "t.csv", ",".join(columns) + "\n" + line + "\n")
    row = readers.read_trade_records(spark, path).collect()[0]
    assert row["refPeriodId"] == 20230101
    assert (row["cmdCode"], row["isLeaf"], row["qty"], row["aggrLevel"]) == ("0101", True, 1.5, 4)


def test_inferred_csv_and_override(spark, tmp_path):
    path = write(tmp_path / "i.csv", "code,v\n0101,1.5\n0102,2\n")
    plain = readers.read_inferred_csv(spark, path)
    assert [f.dataType for f in plain.schema.fields] == [T.IntegerType(), T.DoubleType()]
    kept = readers.read_inferred_csv(spark, path, {"code": T.StringType()})
    assert [tuple(r) for r in kept.collect()] == [("0101", 1.5), ("0102", 2.0)]
    with pytest.raises(ValueError):
        readers.read_inferred_csv(spark, path, {"nope": T.StringType()})


def test_bridge_skips_title_and_header(spark, tmp_path):
    path = write(
        tmp_path / "b.csv",
        "Correspondence NCM x CNAE,,,\nNCM,DESC,CNAE,OTHER\n"
        "01012100.0,Horses,0152-1; 0151-2,x\n02061000,\"Pork, fresh\",XXXX,y\n",
    )
    assert [tuple(r) for r in readers.read_bridge(spark, path).collect()] == [
        ("01012100.0", "Horses", "0152-1; 0151-2"),
        ("02061000", "Pork, fresh", "XXXX"),
    ]


def test_payload_shapes(spark, tmp_path):
    path = write(
        tmp_path / "p.json",
        '{"data": {"list": [{"year": 2023, "state": "Ceará", "metricFOB": 5},'
        ' {"year": 2022, "state": "Bahia", "headingCode": "0101"}]}}\n'
        '{"data": [{"year": 2021, "state": "Pará"}]}\n'
        '{"data": {"list": []}}\n{"data": null}\n{"success": true}\n',
    )
    rows = ingest.landed_exports(spark, path)
    assert as_set(rows, "year", "state", "headingCode", "metricFOB") == {
        (2023, "Ceará", None, 5), (2022, "Bahia", "0101", None), (2021, "Pará", None, None),
    }
    whole = write(tmp_path / "whole.json", '{\n "data": {\n  "list": [\n   {"year": 1}\n  ]\n }\n}\n')
    assert landed.read_payload_rows(spark, whole, "year BIGINT", multi_line=True).collect()[0]["year"] == 1


def test_dataset_folder(spark, tmp_path):
    write(tmp_path / "a.csv", "code\n0101\n")
    write(tmp_path / "b.csv" / "part-0.csv", "v\n1\n")
    write(tmp_path / "b.csv" / "part-1.csv", "v\n2\n")
    write(tmp_path / "readme.txt", "text")
    folder = str(tmp_path)
    tables = landed.read_dataset(spark, folder)
    assert sorted(tables) == ["a.csv", "b.csv"]
    assert as_set(tables["b.csv"], "v") == {(1,), (2,)}
    named = landed.read_dataset(spark, folder, "a.csv", {"code": T.StringType()})
    assert as_set(named, "code") == {("0101",)}
    with pytest.raises(ValueError):
        landed.read_dataset(spark, folder, "readme.txt")
    absent = landed.read_dataset(spark, folder, "absent.csv", absent="code string")
    assert absent.columns == ["code"] and absent.isEmpty()


def test_tables_round_trip_and_missing_file(spark, tmp_path, frame):
    exports = frame(EXPORTS, (2023, "Ceará", "0101", "Horses, \"live\"", 10), (2023, None, "0102", None, None))
    countries = frame(schemas.COUNTRY_PRODUCT, (1, "BRA", 2, "0101", 2023, 3, 4, 0.1, 0.2, 0.3, 0.4, None))
    records = spark.createDataFrame([], schemas.TRADE_RECORDS)
    folder = str(tmp_path / "tables")
    ingest.write_tables(exports, countries, records, folder)
    tables = TradeTables.load(spark, folder)
    columns = exports.columns
    assert as_set(tables.exports, *columns) == as_set(exports, *columns)
    assert as_set(tables.country_product, *countries.columns) == as_set(countries, *countries.columns)
    assert tables.trade_records.count() == 0
    with pytest.raises(AnalysisException):
        TradeTables.load(spark, str(tmp_path / "nowhere"))


def test_latin1_sink(spark, tmp_path, frame):
    df = frame("state string, v long", ("Ceará", 1), ("São Paulo", 2))
    path = sinks.write_stamped_latin1_csv(df, str(tmp_path), datetime(2024, 5, 6, 7, 8, 9))
    assert path.endswith("comtrade_20240506-070809")
    raw = b"".join(p.read_bytes() for p in (tmp_path / "comtrade_20240506-070809").glob("part-*"))
    assert "Ceará".encode("latin-1") in raw
    back = readers.read_typed_csv(spark, path, "state STRING, v BIGINT", encoding="ISO-8859-1")
    assert as_set(back, "state", "v") == {("Ceará", 1), ("São Paulo", 2)}
    with pytest.raises(AnalysisException):
        sinks.write_csv(df, path)


def test_ingestion_keeps_one_classification(spark, tmp_path):
    columns = [f.name for f in T.StructType.fromDDL(schemas.TRADE_RECORDS).fields]
    lines = [
        ",".join({"classificationCode": c, "cmdCode": "0101"}.get(n, "") for n in columns)
        for c in ("H4", "H5", "H4")
    ]
    path = write(tmp_path / "t.csv", "\n".join([",".join(columns), *lines]) + "\n")
    assert ingest.landed_trade_records(spark, path).count() == 2


def test_shared_folder_is_the_named_one(spark, monkeypatch):
    class Conf:
        def __init__(self, **values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf(**values)

    named = Session(**{"spark.checkpoint.dir": "hdfs://nn/shared/", "spark.master": "yarn"})
    assert shared.shared_folder(named) == "hdfs://nn/shared"
    assert shared.new_path(named, "x").startswith("hdfs://nn/shared/x-")
    with pytest.raises(RuntimeError):
        shared.shared_folder(Session(**{"spark.master": "local-cluster[2,1,1024]"}))


RFC_4180 = (
    "year,state,headingCode,heading,metricFOB\n"
    '2023,A,4011,"Pneus ""radial"", novos",100\n'
    '2023,B,4012,"two\nlines",200\n'
    "2023,C,4013,  kept  ,300\n"
)


def test_doubled_quotes_and_line_breaks_are_read(spark, tmp_path):
    path = write(tmp_path / "rfc.csv", RFC_4180)
    rows = readers.read_exports(spark, path, multi_line=True).collect()
    assert [(r.heading, r.metricFOB) for r in rows] == [
        ('Pneus "radial", novos', 100),
        ("two\nlines", 200),
        ("  kept  ", 300),
    ]
    inferred = readers.read_inferred_csv(spark, path, multi_line=True).collect()
    assert [r.metricFOB for r in inferred] == [100, 200, 300]


def test_csv_sinks_keep_texts(spark, tmp_path):
    import csv
    import glob

    texts = [' blanks ', 'a "quote"', "comma, here", "plain"]
    frame = spark.createDataFrame([(t,) for t in texts], "heading string").coalesce(1)
    sinks.write_csv(frame, str(tmp_path / "out"))
    (part,) = glob.glob(str(tmp_path / "out" / "part-*"))
    with open(part, newline="") as file:
        assert [r[0] for r in csv.reader(file)][1:] == texts


def test_payload_numbers_in_quotes_and_many_rows(spark, tmp_path):
    rows = ",".join(f'{{"year":"2023","metricFOB":{v}}}' for v in ('"123"', "5.0", "7", '"x"', "1.5"))
    path = write(tmp_path / "p.json", f'{{"data":[{rows}]}}\n{{"data":{{"list":[{rows}]}}}}\n')
    found = landed.read_payload_rows(spark, path, "year BIGINT, metricFOB BIGINT").collect()
    assert [r.year for r in found] == [2023] * 10
    assert [r.metricFOB for r in found] == [123, 5, 7, None, None] * 2


def test_overrides_of_columns_that_a_table_lacks(spark, tmp_path):
    root = tmp_path / "set"
    root.mkdir()
    write(root / "a.csv", "code,v\n0101,1\n")
    write(root / "b.csv", "v\n2\n")
    from pyspark.sql import types as T

    tables = landed.read_dataset(spark, str(root), overrides={"code": T.StringType()})
    assert tables["a.csv"].first().code == "0101" and tables["b.csv"].first().v == 2


def test_parquet_tables_prune_years(spark, tmp_path):
    from tests.helpers import explain
    from tradespec.sources.tables import TradeTables

    exports = spark.createDataFrame(
        [(2022, "A", "0101", "x", 1), (2023, "B", "0102", "y", 2)], schemas.EXPORTS
    )
    other = spark.createDataFrame([], schemas.COUNTRY_PRODUCT)
    records = spark.createDataFrame([], schemas.TRADE_RECORDS)
    ingest.write_tables(exports, other, records, str(tmp_path / "t"), "parquet")
    loaded = TradeTables.load(spark, str(tmp_path / "t"), "parquet")
    kept = loaded.exports.where("year = 2023 and state = 'B'").select("metricFOB")
    assert [r.metricFOB for r in kept.collect()] == [2]
    plan = explain(kept)
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(state,B)" in plan


def test_list_filters_take_the_column_type(spark):
    from tradespec.operators.filters import members

    frame = spark.createDataFrame([("Ceará",), ("23",)], "state string")
    assert [r.state for r in members(frame, "state", [23]).collect()] == ["23"]


def test_absent_weights_are_zero_and_nan_is_no_money(spark):
    from tradespec.functions.money import money_text
    from tradespec.operators.priority import Weights

    assert Weights.named({"entity": 1.0}) == Weights(1.0, 0.0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        Weights.named({"entitiy": 1.0})
    frame = spark.createDataFrame([(float("nan"),), (2.5e6,)], "v double")
    assert [r[0] for r in frame.select(money_text("v")).collect()] == [None, "$2,50 Mi"]
