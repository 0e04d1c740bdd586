import pytest

from tests.helpers import EXPORTS, by_key
from tradespec import comparison_table, legacy_comparison_table, names, selection_report
from tradespec.operators.filters import Selection
from tradespec.operators.priority import Weights
from tradespec.plans.comparison import comparison_view, headings_with_rca, legacy_view, with_headers
from tradespec.plans.country import country_summary, top_products
from tradespec.plans.three_source import three_source_table

COUNTRY = "country_iso3_code string, product_hs92_code string, year long, export_rca double, pci double, distance double"
BRIDGE = "ncm8_raw string, ncm_descricao string, cnae_raw string"


@pytest.fixture
def exports(frame):
    return frame(
        EXPORTS,
        (2023, "Ceará", "101", "Horses", 60),
        (2023, "Bahia", "0101", "Horses", 60),
        (2023, "Ceará", "0102", "Cattle", 40),
        (2023, "Bahia", "0102", "Bovines", 140),
        (2023, "Bahia", "0103", "Swine", 100),
        (2023, "Bahia", "0104", "Sheep", 0),
        (2023, "Bahia", "0", "Zero", 0),
        (2023, "Bahia", None, "No code", 0),
    )


@pytest.fixture
def countries(frame):
    return frame(
        COUNTRY,
        ("BRA", "0101", 2023, 2.0, 1.0, 0.5),
        ("ARG", "101", 2023, 1.0, 3.0, 0.7),
        ("BRA", "0102", 2023, 0.6, -1.0, 0.9),
    )


def test_comparison_by_hand(exports, countries, frame):
    bridge = frame(BRIDGE, ("1012100", "Horses", "0152-1"))
    table = comparison_table(exports, countries, bridge)
    rows = {(r["headingCode"], r["heading"]): r for r in table.collect()}
    # 0102 has two descriptions; 0104 and the unusable codes export nothing.
    assert set(rows) == {
        ("0101", "Horses"), ("0102", "Cattle"), ("0102", "Bovines"), ("0103", "Swine"),
    }
    horses, cattle, swine = (rows[k] for k in (("0101", "Horses"), ("0102", "Cattle"), ("0103", "Swine")))
    # Totals: Ceará 100, all 400.
    assert horses[names.ENTITY_RCA] == pytest.approx((60 / 100) / (120 / 400))
    assert cattle[names.ENTITY_RCA] == pytest.approx((40 / 100) / (180 / 400))
    assert swine[names.ENTITY_RCA] == 0.0
    assert horses[names.COUNTRY_RCA] == 1.5 and horses[names.PCI] == 2.0
    # Swine has no metrics: zeros, which take part in the normalization.
    assert (swine[names.COUNTRY_RCA], swine[names.PCI], swine[names.DISTANCE]) == (0, 0, 0)
    assert swine[f"{names.PCI}_norm"] == pytest.approx(1 / 3)
    assert cattle[f"{names.PCI}_norm"] == 0.0
    assert (horses[names.SCENARIO], cattle[names.SCENARIO], swine[names.SCENARIO]) == (
        "Cenário 1", "Cenário 4", "Cenário 7",
    )
    assert horses[names.PRIORITY] == pytest.approx(0.4 + 0.3 + 0.3 + 0.4 * 0.6 / 0.9)
    assert horses["ncm8"] == "01012100" and cattle["ncm8"] is None


def test_view_filters_do_not_change_the_normalization(exports, countries):
    table = comparison_table(exports, countries)
    whole = by_key(table.where("heading <> 'Bovines'"), "headingCode", names.PRIORITY)
    view = comparison_view(table, "0102", "0103", ["Cenário 4", "Cenário 7"])
    got = [(r["headingCode"], r[names.PRIORITY]) for r in view.where("heading <> 'Bovines'").collect()]
    assert got == sorted(((c, whole[c]) for c in ("0102", "0103")), key=lambda x: -x[1])
    assert comparison_view(table).count() == 4
    assert [r["ncm8"] for r in table.collect()] == ["Não disp."] * 4
    named = with_headers(comparison_view(table), names.COMPARISON_HEADERS)
    assert named.columns == list(names.COMPARISON_HEADERS.values())


def test_no_comparison_without_the_entity(exports, countries):
    assert comparison_table(exports, countries, entity="Acre").collect() == []


def test_country_parameter(exports, countries):
    one = comparison_table(exports, countries, country="BRA", weights=Weights(entity=1.0))
    row = one.where("headingCode = '0101'").collect()[0]
    assert row[names.COUNTRY_RCA] == 2.0
    assert row["X"] == 1.0


def test_headings_with_rca_equals_the_join(exports):
    from tradespec.operators.options import heading_reference
    from tradespec.operators.rca import entity_rca

    joined = entity_rca(exports, pad=4).join(heading_reference(exports), "headingCode", "left")
    ours = headings_with_rca(exports).where(f"{names.ENTITY_RCA} is not null")
    columns = ["headingCode", "heading", names.ENTITY_RCA]
    assert sorted(map(tuple, ours.select(columns).collect())) == sorted(
        map(tuple, joined.select(columns).collect())
    )


def test_legacy_comparison(exports, countries):
    table = legacy_comparison_table(exports, countries)
    rows = {(r["headingCode"], r["heading"]): r for r in table.collect()}
    assert set(rows) == {
        ("101", "Horses"), ("0101", "Horses"), ("0102", "Cattle"), ("0102", "Bovines"),
        ("0103", "Swine"), ("0104", "Sheep"),
    }
    own, other, sheep = rows["101", "Horses"], rows["0101", "Horses"], rows["0104", "Sheep"]
    # Codes are taken as they are: all of 101 is Ceará's.
    assert own[names.ENTITY_RCA] == pytest.approx((60 / 100) / (60 / 400))
    assert (own["PCI"], other["PCI"]) == (3.0, 1.0)
    assert other[names.ENTITY_RCA] == 0.0
    # Above 1 the RCA is averaged with the complexity.
    assert own[names.ADJUSTED_RCA] == pytest.approx((4.0 + 3.0) / 2)
    assert sheep[names.ENTITY_RCA] is None and sheep[f"{names.ENTITY_RCA}_NORM"] is None
    assert sheep["PCI_NORM"] == 0.0 and sheep[names.ADJUSTED_RCA] == 0.0
    # Nothing known: only the proximity part, at full strength.
    assert sheep[names.PRIORITY] == pytest.approx(round(0.4 / 1.7, 3))
    for columns in (names.LEGACY_NORMALIZED, names.LEGACY_RAW):
        assert legacy_view(table, columns).columns == list(columns)
    view = legacy_view(table)
    shown = {(r["Código HS"], r["Descrição"]): r for r in view.collect()}
    assert shown["0104", "Sheep"]["VCR estadual (Bruto)"] == "N/A"
    assert shown["101", "Horses"]["PCI (Bruto)"] == "3.0"
    indices = [float(r["Índice de Prioridade Ajustado"]) for r in view.collect()]
    assert indices == sorted(indices, reverse=True)


def test_selection_report(exports):
    report = selection_report(exports, Selection(states=("Ceará",)))
    headline = report["headline"].collect()[0]
    assert (headline["selected_total"], headline["overall_total"]) == (100, 400)
    table = report["table"].collect()
    assert list(table[0].asDict()) == list(names.SELECTION_HEADERS.values())
    assert [r["Código HS"] for r in table] == ["101", "0102", "0102"]
    assert table[0]["Valor FOB (US$)"] == "$60,00"
    bars = [(r["heading"], r["metricFOB"]) for r in report["bars"].collect()]
    assert bars == [("Horses", 60), ("Cattle", 40)]


FULL_COUNTRY = (
    "country_iso3_code string, product_hs92_code string, year long, product_id long, export_value long, "
    "import_value long, global_share double, export_rca double, distance double, cog double, pci double"
)


def test_country_reports(frame):
    df = frame(
        FULL_COUNTRY,
        ("BRA", "0101", 2023, 1, 3_000_000, 2_000_000_000, 0.0625, 1.0, 0.5, 0.2, 1.0),
        ("BRA", "0102", 2023, 2, 1_000_000, 0, 0.0625, 1.0, 0.5, 0.2, 2.0),
        ("ARG", "0102", 2023, 2, 9, 0, 0.0625, 1.0, 0.5, 0.2, 2.0),
    )
    row = country_summary(df, countries=["BRA"]).collect()
    assert len(row) == 1
    assert tuple(row[0])[:5] == ("BRA", 2023, "$4,00M", "$2,00B", 0.062)
    top = top_products(df, k=1, countries=["BRA"]).collect()
    assert [(r["product_hs92_code"], r["proportion"], r["proportion_text"]) for r in top] == [("0101", 0.75, "75.00%")]


def test_three_source_table(frame, exports):
    countries = frame(FULL_COUNTRY, *[
        ("BRA", code, 2023, 1, 5, 0, 0.1, 1.0, 0.5, 0.2, 1.0) for code in ("0102", "0103", "9999", "01AB")
    ])
    records = frame(
        "cmdCode string, refYear long, reporterISO string, primaryValue double",
        ("0102", 2023, "BRA", 1.0), ("0102", 2023, "BRA", 2.0), ("0103", 2022, "BRA", 3.0), ("TOTAL", 2023, "BRA", 9.0),
    )
    rows = three_source_table(countries, records, exports).collect()
    got = sorted(
        (r["product_hs92_code"], r["primaryValue"] or 0, r["total_metricFOB"], r["state_records_count"]) for r in rows
    )
    assert got == [("0102", 1.0, 180, 2), ("0102", 2.0, 180, 2), ("0103", 0, 100, 1), ("9999", 0, None, None)]
