"""Filters, option lists, summaries, bridge, cube and records."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import EXPORTS, as_set, by_key
from tradespec import names
from tradespec.operators import bridge, cube, filters, joins, options, records, summaries
from tradespec.operators.complexity import product_metrics
from tradespec.plans import trade_records

NAN = float("nan")


def sample(frame):
    return frame(
        EXPORTS,
        (2022, "Ceará", "0101", "Horses", 10),
        (2023, "Ceará", "0102", "Cattle", 0),
        (2023, "Bahia", "0101", "Horses", -3),
        (2023, "Bahia", "0", "Zero", None),
        (2023, None, None, "Nothing", 7),
        (None, "Acre", "5", "Short", 1),
    )


# --- filters ---


def test_filters(frame):
    df = sample(frame)
    assert filters.positive_values(df).count() == 3
    assert filters.equal_to(df, "state", "Bahia").count() == 2
    assert as_set(filters.latest(df), "year") == {(2023,)}
    assert as_set(filters.code_between(df, "0101", "0101"), "headingCode") == {("0101",)}
    assert as_set(filters.code_between(df, last="0101"), "headingCode") == {("0",), ("0101",)}
    assert filters.code_between(df).count() == 6
    assert as_set(filters.valid_headings(df), "headingCode") == {("0101",), ("0102",)}
    assert as_set(filters.four_digit_codes(df, "headingCode"), "headingCode") == {("0101",), ("0102",)}


def test_empty_membership_does_not_filter(frame):
    df = sample(frame)
    for nothing in (None, [], ()):
        assert filters.members(df, "state", nothing).count() == 6
    assert filters.Selection().apply(df).count() == 6
    assert filters.members(df, "state", ["Acre"]).count() == 1


def test_membership_as_semi_join_does_not_multiply(frame):
    df = sample(frame)
    wanted = frame("s string", ("Ceará",), ("Ceará",), (None,))
    assert filters.members(df, "state", wanted).count() == 2


def test_selection_combines_its_parts(frame):
    chosen = filters.Selection(states=("Ceará", "Bahia"), years=(2023,), products=("0101",))
    assert as_set(chosen.apply(sample(frame)), "state", "metricFOB") == {("Bahia", -3)}


# --- options ---


def test_options(frame):
    df = sample(frame)
    assert [r["state"] for r in options.distinct_options(df, "state").collect()] == ["Acre", "Bahia", "Ceará"]
    assert [r["year"] for r in options.distinct_options(df, "year", "int").collect()] == [2022, 2023]
    assert options.default_option(df, "state", "Ceará").collect()[0]["state"] == "Ceará"
    assert options.default_option(df, "state", "Pará").collect()[0]["state"] == "Acre"
    assert options.default_option(df.where("false"), "state", "Pará").collect()[0]["state"] is None
    labels = [r["HS_Desc"] for r in options.product_options(df, ["Ceará"], [2023]).collect()]
    assert labels == ["0102 - Cattle..."]


def test_reference_pads_before_dropping_duplicates(frame):
    df = frame(EXPORTS, (1, "s", "101", "a", 1), (1, "s", "0101", "a", 1), (1, "s", "0101", "b", 1))
    assert sorted(map(tuple, options.heading_reference(df).collect())) == [("0101", "a"), ("0101", "b")]


# --- summaries ---


def test_totals_leave_out_missing_keys(frame):
    got = by_key(summaries.exports_by_state(sample(frame)), "state", "metricFOB")
    assert got == {"Ceará": 10, "Bahia": -3, "Acre": 1}


def test_lump_small_shares(frame):
    schema = "heading string, state string, metricFOB long, percentage double"

    def lump(*values):
        total = sum(values)
        rows = [(f"h{i}", "s", v, v / total if total else None) for i, v in enumerate(values)]
        result = summaries.lump_small(frame(schema, *rows))
        return {(r["heading"], r["state"]): (r["metricFOB"], r["percentage"]) for r in result.collect()}

    # Exactly 2% stays, 1% and 1.5% are lumped.
    got = lump(955, 20, 10, 15)
    other = got.pop(("Demais/Outros (< 2%)", "Agregado"))
    assert other == pytest.approx((25, 0.025))
    assert set(got) == {("h0", "s"), ("h1", "s")}
    # None below the threshold: no extra row.
    assert set(lump(50, 50)) == {("h0", "s"), ("h1", "s")}
    # Everything below it: only the extra row.
    assert lump(*[1] * 100) == {("Demais/Outros (< 2%)", "Agregado"): (100, pytest.approx(1.0))}
    # No total, no shares: the rows stay as they are.
    assert lump(0, 0) == {("h0", "s"): (0, None), ("h1", "s"): (0, None)}


def test_lumping_keeps_the_total(frame):
    rows = [(2023, f"S{i % 3}", f"{i:04d}", f"h{i}", i * i) for i in range(60)]
    shares = summaries.heading_shares(frame(EXPORTS, *rows))
    lumped = summaries.lump_small(shares).agg(F.sum("metricFOB"), F.sum("percentage")).collect()[0]
    assert lumped[0] == sum(i * i for i in range(60))
    assert lumped[1] == pytest.approx(1.0)


COUNTRY_PRODUCT = (
    "country_iso3_code string, product_hs92_code string, year long, product_id long, "
    "export_value long, import_value long, global_share double, export_rca double, "
    "distance double, cog double, pci double"
)


def country_rows(frame):
    return frame(
        COUNTRY_PRODUCT,
        ("BRA", "101", 2022, 1, 10, 5, 0.1, 1.0, 0.5, 0.2, NAN),
        ("BRA", "0101", 2023, 1, 30, None, 0.3, 3.0, None, 0.4, 1.0),
        ("ARG", "0102", 2023, None, 60, 5, NAN, 2.0, 0.7, 0.6, None),
        (None, "0102", 2023, 2, 100, 5, 0.5, 8.0, 0.7, 0.6, 2.0),
        ("ARG", None, 2023, 2, 7, 5, 0.5, 9.0, 0.7, 0.6, 2.0),
    )


def test_product_metrics_average_all_countries(frame):
    got = by_key(product_metrics(country_rows(frame)), "headingCode", names.COUNTRY_RCA, names.PCI, names.DISTANCE)
    assert got == {"0101": (2.0, 1.0, 0.5), "0102": (5.0, 2.0, 0.7)}
    prefix = by_key(product_metrics(country_rows(frame), code_mode="prefix"), "headingCode", names.COUNTRY_RCA)
    assert prefix == {"101": 1.0, "0101": 3.0, "0102": 5.0}
    one = by_key(product_metrics(country_rows(frame), country="BRA"), "headingCode", names.COUNTRY_RCA)
    assert one == {"0101": 2.0}
    with pytest.raises(ValueError):
        product_metrics(country_rows(frame), code_mode="other")


def test_country_year_summary(frame):
    df = summaries.country_year_summary(country_rows(frame))
    got = {
        (r["country_iso3_code"], r["year"]): (r["export_value"], r["import_value"], r["global_share"], r["pci"], r["product_id"])
        for r in df.collect()
    }
    assert got == {
        ("BRA", 2022): (10, 5, 0.1, None, 1),
        ("BRA", 2023): (30, 0, 0.3, 1.0, 1),
        ("ARG", 2023): (67, 10, 0.5, 2.0, 1),
    }


def test_product_exports_and_top(frame):
    df = summaries.product_exports(country_rows(frame))
    got = by_key(df, "product_hs92_code", "total_export", "proportion")
    assert got == {"101": (10, 0.05), "0101": (30, 0.15), "0102": (160, 0.8)}
    best = summaries.top(df, "total_export", "product_hs92_code", 2).collect()
    assert [(r["product_hs92_code"], r["proportion"]) for r in best] == [("0102", 0.8), ("0101", 0.15)]


def test_headline_numbers(frame):
    row = summaries.headline_numbers(sample(frame), filters.Selection(states=("Ceará",))).collect()[0]
    assert tuple(row) == (10, 15, "$10,00", "$15,00", "$49,71 Tri")
    empty = summaries.headline_numbers(sample(frame).where("false"), filters.Selection()).collect()[0]
    assert (empty["selected_total"], empty["overall_text"]) == (0, "$0,00")


# --- bridge ---

BRIDGE = "ncm8_raw string, ncm_descricao string, cnae_raw string"


def bridge_rows(frame):
    return frame(
        BRIDGE,
        ("1012100.0", "Horses", "0152-1; 01.51-2"),
        ("01012900", "Other horses", "0152-1; 01.51-2"),
        ("01012900", "Other horses", "XXXX"),
        ("01013000", "Asses", None),
        ("2061000", "Pork", "SEM TEC"),
        (None, "No code", "0101-1"),
        ("03000000", "Nothing", "NaN"),
    )


def test_product_activities(frame):
    got = as_set(bridge.product_activities(bridge_rows(frame)), "ncm8", "sh4", "cnae7")
    assert got == {
        ("01012100", "0101", "01521"), ("01012100", "0101", "01512"),
        ("01012900", "0101", "01521"), ("01012900", "0101", "01512"),
    }


def test_codes_per_heading(frame):
    got = by_key(bridge.codes_per_heading(bridge_rows(frame)), "headingCode", "ncm8", "cnae_raw")
    assert got == {
        "0101": ("01012100, 01012900, 01013000", "0152-1; 01.51-2, XXXX"),
        "0206": ("02061000", "SEM TEC"),
        "0300": ("03000000", ""),
    }


def test_attach_codes(frame):
    products = frame("headingCode string", ("0101",), ("9999",))
    got = by_key(bridge.attach_codes(products, bridge_rows(frame)), "headingCode", "cnae_raw")
    assert got == {"0101": "0152-1; 01.51-2, XXXX", "9999": None}
    without = by_key(bridge.attach_codes(products, None), "headingCode", "ncm8", "cnae_raw")
    assert without == {"0101": ("Não disp.", "Não disp."), "9999": ("Não disp.", "Não disp.")}


def test_client_rows(frame):
    pairs = bridge.product_activities(bridge_rows(frame))
    assert filters.client_rows(pairs, ["01012100"]).count() == 2
    assert filters.client_rows(pairs, ["01012100"], ["01512"]).count() == 1
    assert filters.client_rows(pairs, []).count() == 0
    products = frame("code string", ("01012900",))
    assert filters.client_rows(pairs, products, ["01521"]).count() == 1


# --- joins ---


def test_left_join_many_keeps_every_left_row(frame):
    left = frame("a string, y long, v long", ("x", 1, 10), ("x", 2, 20), (None, 1, 30), ("z", 1, 40))
    right = frame("b string, yy long, v long", ("x", 1, 7), ("x", 1, 8), (None, 1, 9), ("q", 1, 5))
    got = joins.left_join_many(left, right, ("a", "y"), ("b", "yy"), "_r")
    assert got.columns == ["a", "y", "v", "v_r"]
    expected = {("x", 1, 10, 7), ("x", 1, 10, 8), ("x", 2, 20, None), (None, 1, 30, None), ("z", 1, 40, None)}
    assert as_set(got, "a", "y", "v", "v_r") == expected
    assert got.count() == 5
    unique = right.where("v <> 8")
    one = joins.left_join_one(left, unique, ("a", "y"), ("b", "yy"), "_r")
    assert as_set(one, "a", "y", "v", "v_r") == expected - {("x", 1, 10, 8)}


# --- cube ---

SHIPMENTS = "flow string, year long, month long, state string, city string, heading string, metricFOB long, metricKG long, metricCIF long"


def shipments(frame):
    return frame(
        SHIPMENTS,
        ("export", 2022, 12, "23", "Sobral", "h1", 1, 1, 1),
        ("export", 2023, 1, "23", "Sobral", "h1", 2, 2, 2),
        ("export", 2023, 12, "23", "Crato", "h2", 4, None, 4),
        ("export", 2023, 5, "29", "Ilhéus", "h1", 8, 8, 8),
        ("import", 2023, 5, "23", "Sobral", "h1", 16, 16, 16),
        ("export", 2024, 1, "23", "Sobral", "h1", 32, 32, 32),
    )


def test_cube_query(frame):
    got = cube.cube_query(shipments(frame), cube.STATE_HEADING_2021_2023)
    assert as_set(got, "year", "state", "heading", "metricFOB") == {
        (2022, "23", "h1", 1), (2023, "23", "h1", 2), (2023, "23", "h2", 4), (2023, "29", "h1", 8),
    }
    one_state = cube.cube_query(shipments(frame), cube.STATE_23_HEADING_2023)
    assert as_set(one_state, "heading", "metricFOB", "metricKG") == {("h1", 2, 2), ("h2", 4, 0)}


def test_cube_by_city_and_month(frame):
    got = cube.cube_query(shipments(frame), cube.CubeSpec.by_city(2023, "23"))
    assert as_set(got, "city", "metricFOB") == {("Sobral", 2), ("Crato", 4)}
    monthly = cube.CubeSpec("export", "2022-12", "2023-05", metrics=("metricFOB",), month_detail=True)
    assert as_set(cube.cube_query(shipments(frame), monthly), "year", "month", "metricFOB") == {
        (2022, 12, 1), (2023, 1, 2), (2023, 5, 8),
    }
    no_metrics = cube.CubeSpec("export", "2023-01", "2023-12", details=("state",))
    assert as_set(cube.cube_query(shipments(frame), no_metrics), "state") == {("23",), ("29",)}


def test_cube_spec_is_checked():
    for wrong in (("both", "2023-01", "2023-12"), ("export", "2023", "2023-12")):
        with pytest.raises(ValueError):
            cube.CubeSpec(*wrong)


# --- records ---

RECORDS = (
    "typeCode string, freqCode string, classificationSearchCode string, period long, "
    "reporterCode string, cmdCode string, cmdDesc string, flowCode string, partnerCode string, "
    "partner2Code string, customsCode string, motCode string, primaryValue double, netWgt double, qty double"
)


def record_rows(frame):
    base = ("C", "A", "HS", 2023, "32", "0101", "Horses", "X", "76", "0", "C00", "0", 10.0, 1.0, 2.0)
    names_ = [part.split()[0] for part in RECORDS.split(", ")]

    def row(**changes):
        return tuple(changes.get(n, v) for n, v in zip(names_, base))

    return frame(
        RECORDS,
        row(),
        row(cmdCode="010121", primaryValue=5.0),
        row(cmdCode="TOTAL", primaryValue=50.0),
        row(period=2022, primaryValue=20.0, netWgt=None),
        row(flowCode="M"),
        row(partnerCode="0"),
        row(reporterCode="858", primaryValue=7.0),
        row(customsCode="C01"),
    )


def test_record_filter(frame):
    df = record_rows(frame)

    def total(**changes):
        result = records.query_records(df, records.RecordFilter(**changes))
        return sorted(r["primaryValue"] for r in result.collect())

    assert total() == [7.0, 10.0]
    assert total(period="2022, 2023") == [7.0, 10.0, 20.0]
    assert total(cmdCode="AG6") == [5.0]
    assert total(cmdCode="TOTAL,AG6") == [5.0, 50.0]
    assert total(reporterCode="858,32") == [7.0, 10.0]
    assert total(cmdCode=None, period=None, flowCode=None, partnerCode=None, customsCode=None) == sorted(
        [10.0, 5.0, 50.0, 20.0, 10.0, 10.0, 7.0, 10.0]
    )


def test_record_output_options(frame):
    df = record_rows(frame)
    assert records.query_records(df, records.RecordFilter(countOnly=True)).collect()[0]["count"] == 2
    rolled = records.query_records(df, records.RecordFilter(period=None, aggregateBy="period"))
    assert as_set(rolled, "period", "primaryValue", "netWgt", "qty") == {
        (2023, 17.0, 2.0, 4.0), (2022, 20.0, 0.0, 2.0),
    }
    plain = records.query_records(df, records.RecordFilter(includeDesc=False, maxRecords=1))
    assert "cmdDesc" not in plain.columns and plain.count() == 1


def test_cube_needs_city_data_for_cities():
    assert cube.CubeSpec.by_city(2023, 23).data_type == "cities"
    with pytest.raises(ValueError):
        cube.CubeSpec("export", "2023-01", "2023-12", details=("city",))
    with pytest.raises(ValueError):
        cube.CubeSpec("export", "2023-01", "2023-12", data_type="other")


def test_a_missing_state_counts_as_one_more(frame):
    count = summaries.number_of_states
    some = frame("state STRING", ("A",), (None,), ("A",), (None,))
    assert [tuple(r) for r in count(some).collect()] == [(2, False)]
    assert [tuple(r) for r in count(some.where("state IS NULL")).collect()] == [(1, True)]
    assert [tuple(r) for r in count(some.where("state = 'B'")).collect()] == [(0, False)]


def test_records_report_orders_shares_of_what_is_chosen(frame):
    rows = frame(
        "refYear BIGINT, cmdCode STRING, cmdDesc STRING, primaryValue BIGINT",
        (2020, "0101", "b", 30),
        (2020, "0101", "a", 30),
        (2020, "0102", "c", 40),
        (2021, "0101", "a", 900),
        (2020, "0102", "d", None),
    )
    report = trade_records.records_report(rows, years=(2020,))
    assert report["table"].count() == 4
    got = [(r.cmdDesc, r.primaryValue) for r in report["shares"].collect()]
    assert got[:3] == [("c", 40), ("a", 30), ("b", 30)]
    assert trade_records.chosen_records(rows, codes=("0101",)).count() == 3
    assert trade_records.chosen_records(rows).count() == 5
