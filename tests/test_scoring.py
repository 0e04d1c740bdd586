import itertools

import pytest

from tests.helpers import by_key
from tradespec import names
from tradespec.operators.normalize import min_max
from tradespec.operators.priority import (
    Weights,
    adjusted_rca,
    linear_priority,
    nested_priority,
    ranked,
)
from tradespec.operators.scenarios import classify_scenarios, scenario_text

NAN = float("nan")
NORMED = "headingCode string, " + ", ".join(
    f"{m}_norm double" for m in names.COMPARISON_METRICS
)


def test_min_max_skips_missing_values(frame):
    df = frame("k string, x double", ("a", 1.0), ("b", 3.0), ("c", None), ("d", NAN), ("e", 5.0))
    got = by_key(min_max(df, ["x"]), "k", "x_norm")
    assert got == {"a": 0.0, "b": 0.5, "c": None, "d": None, "e": 1.0}


def test_min_max_of_equal_values_is_zero(frame):
    df = frame("k string, x double", ("a", 2.0), ("b", 2.0), ("c", None))
    assert by_key(min_max(df, ["x"]), "k", "x_norm") == {"a": 0.0, "b": 0.0, "c": 0.0}


def test_min_max_without_any_value(frame):
    df = frame("k string, x double", ("a", None), ("b", None))
    assert by_key(min_max(df, ["x"]), "k", "x_norm") == {"a": None, "b": None}
    coerced = min_max(df, ["x"], "_NORM", coerce=True)
    assert by_key(coerced, "k", "x_NORM") == {"a": 0.0, "b": 0.0}


def test_min_max_reads_text_as_numbers(frame):
    df = frame("k string, x string", ("a", "1"), ("b", "n/a"), ("c", "3"))
    got = by_key(min_max(df, ["x"], "_NORM", coerce=True), "k", "x_NORM")
    assert got == {"a": 0.0, "b": None, "c": 1.0}


def test_min_max_of_several_columns_stays_in_range(frame):
    rows = [(str(i), float(i % 7), float(i * i % 11)) for i in range(50)]
    df = min_max(frame("k string, x double, y double", *rows), ["x", "y"])
    for row in df.collect():
        assert 0.0 <= row["x_norm"] <= 1.0 and 0.0 <= row["y_norm"] <= 1.0
    assert df.columns == ["k", "x", "y", "x_norm", "y_norm"]


# Scenario of each (entity, country) pair, worked out by hand; columns in the
# order of LEVELS, None standing for a missing value.
LEVELS = [None, 0.0, 0.49, 0.5, 0.99, 1.0, 1.01]
EXPECTED = {
    None: [7, 7, 7, 7, 7, 7, 7],
    0.0: [7, 7, 6, 6, 6, 3, 3],
    0.49: [7, 7, 6, 6, 6, 3, 3],
    0.5: [7, 5, 5, 4, 4, 3, 3],
    0.99: [7, 5, 5, 4, 4, 3, 3],
    1.0: [7, 2, 2, 2, 2, 1, 1],
    1.01: [7, 2, 2, 2, 2, 1, 1],
}


def test_all_scenario_boundaries(frame):
    pairs = list(itertools.product(LEVELS, LEVELS))
    schema = f"i int, {names.ENTITY_RCA} double, {names.COUNTRY_RCA} double"
    df = frame(schema, *[(i, a, b) for i, (a, b) in enumerate(pairs)])
    got = by_key(classify_scenarios(df), "i", names.SCENARIO)
    for i, (a, b) in enumerate(pairs):
        assert got[i] == f"Cenário {EXPECTED[a][LEVELS.index(b)]}", (a, b)


def test_scenario_texts(frame):
    df = frame("s string", *[(s,) for s in names.SCENARIO_TEXTS], ("other",))
    got = {r["s"]: r["t"] for r in df.select("s", scenario_text("s").alias("t")).collect()}
    assert got == {**names.SCENARIO_TEXTS, "other": None}


def test_not_a_number_is_scenario_seven(frame):
    schema = f"i int, {names.ENTITY_RCA} double, {names.COUNTRY_RCA} double"
    df = frame(schema, (0, NAN, 2.0), (1, 2.0, NAN))
    assert set(by_key(classify_scenarios(df), "i", names.SCENARIO).values()) == {"Cenário 7"}


def test_linear_priority(frame):
    df = frame(NORMED, ("0101", 1.0, 1.0, 1.0, 1.0), ("0102", 0.5, 0.0, 1.0, 0.25), ("0103", None, 1.0, 1.0, 1.0))
    got = by_key(linear_priority(df), "headingCode", "X", "Y", "Z", "AA", names.PRIORITY)
    assert got["0101"] == pytest.approx((0.4, 0.3, 0.3, 0.4, 1.4))
    assert got["0102"] == pytest.approx((0.2, 0.0, 0.3, 0.1, 0.6))
    assert got["0103"][4] is None


def test_linear_priority_with_one_weight_is_that_column(frame):
    df = frame(NORMED, ("0101", 0.1, 0.2, 0.3, 0.4))
    for name, value in (("entity", 0.1), ("country", 0.2), ("pci", 0.3), ("distance", 0.4)):
        zero = dict.fromkeys(("entity", "country", "adjusted", "pci", "distance"), 0.0)
        row = linear_priority(df, Weights(**{**zero, name: 1.0})).collect()[0]
        assert row[names.PRIORITY] == pytest.approx(value)


def test_linear_priority_counts_an_absent_column_as_zero(frame):
    df = frame(NORMED, ("0101", 1.0, 1.0, 1.0, 1.0)).drop(f"{names.PCI}_norm")
    assert linear_priority(df).collect()[0][names.PRIORITY] == pytest.approx(1.1)


def test_adjusted_rca(frame):
    schema = f"headingCode string, {names.ENTITY_RCA} double, PCI double"
    df = frame(schema, ("a", 2.0, 1.0), ("b", 2.0, None), ("c", 1.0, 5.0), ("d", None, 5.0))
    got = by_key(adjusted_rca(df), "headingCode", names.ADJUSTED_RCA)
    assert got == {"a": 1.5, "b": 1.0, "c": 1.0, "d": 0.0}


NESTED = "headingCode string, " + ", ".join(
    f"{m}_NORM double" for m in (*names.COMPARISON_METRICS, names.ADJUSTED_RCA)
)


def test_nested_priority(frame):
    df = frame(NESTED, ("a", 0.8, 0.4, 0.6, 0.1, 0.5), ("b", None, None, None, None, None))
    rows = by_key(nested_priority(df), "headingCode", names.PRIORITY, "PCI_NORM")
    composite = 0.8 * 0.4 + 0.4 * 0.3 + 0.5 * 0.3
    assert rows["a"] == pytest.approx(((composite + 0.6 * 0.3 + 0.9 * 0.4) / 1.7, 0.6))
    assert rows["b"] == pytest.approx((0.4 / 1.7, 0.0))


def test_nested_priority_without_rca_weights(frame):
    df = frame(NESTED, ("a", 0.9, 0.3, 0.0, 1.0, 0.6))
    zero = Weights(entity=0, country=0, adjusted=0, pci=0, distance=0)
    three = nested_priority(df, zero).collect()[0][names.PRIORITY]
    assert three == pytest.approx((0.9 + 0.3 + 0.6) / 3)
    two = nested_priority(df, zero, use_adjusted=False).collect()[0][names.PRIORITY]
    assert two == pytest.approx((0.9 + 0.3) / 2)


def test_ranking_puts_missing_last_and_breaks_ties_by_code(frame):
    df = frame(
        f"headingCode string, {names.PRIORITY} double",
        ("b", 1.0), ("a", 1.0), ("c", None), ("d", 2.0),
    )
    assert [r["headingCode"] for r in ranked(df).collect()] == ["d", "a", "b", "c"]
