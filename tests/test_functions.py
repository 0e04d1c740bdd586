import pytest
from pyspark.sql import functions as F

from tradespec.functions import codes, money, numbers, periods


def values(frame, schema, rows, expression):
    df = frame(schema, *[(r,) for r in rows])
    return [r["y"] for r in df.select(expression.alias("y")).collect()]


def test_zero_pad_never_truncates(frame):
    got = values(frame, "x string", ["1", "0101", "12345", "", None], codes.zero_pad("x", 4))
    assert got == ["0001", "0101", "12345", "0000", None]


def test_code_cleaning(frame):
    assert values(frame, "x string", ["10.0", "10.05", "1.0.0"], codes.strip_decimal_suffix("x")) == [
        "10", "10.05", "1.0",
    ]
    assert values(frame, "x string", [" 01.51-2 ", "XX", None], codes.strip_code_marks("x")) == [
        "01512", "XX", None,
    ]
    assert values(frame, "x string", ["12", "1a", "", "1.0"], codes.all_digits("x")) == [
        True, False, False, False,
    ]
    assert values(frame, "x string", ["1234", "12345", "123"], codes.exactly_digits("x")) == [
        True, False, False,
    ]


def test_labels_go_back_to_codes(frame):
    df = frame("code string, text string", ("0101", "a - b" + "x" * 60), ("0102", None))
    label = codes.option_label("code", "text")
    rows = df.select(label.alias("label")).collect()
    assert rows[0]["label"] == "0101 - a - b" + "x" * 45 + "..."
    assert rows[1]["label"] is None
    back = df.select(codes.code_from_label(label).alias("code")).collect()
    assert back[0]["code"] == "0101"


@pytest.mark.parametrize(
    ("amount", "text"),
    [
        (0.0, "$0,00"),
        (999999.99, "$999.999,99"),
        (1e6, "$1,00 Mi"),
        (1e9, "$1,00 Bi"),
        (1e12, "$1,00 Tri"),
        (-5.0, "$-5,00"),
        (-5e9, "$-5.000.000.000,00"),
        (0.125, "$0,12"),
        (1234567890123456.0, "$1.234,57 Tri"),
        (None, None),
    ],
)
def test_money_text(frame, amount, text):
    assert values(frame, "x double", [amount], money.money_text("x")) == [text]


def test_money_text_variants(frame):
    assert values(frame, "x long", [1500000], money.money_text("x", prefix="")) == ["1,50 Mi"]
    tight = money.money_text("x", suffixes=money.TIGHT_SUFFIXES)
    assert values(frame, "x long", [1500000, 2 * 10**9, 3 * 10**12], tight) == [
        "$1,50M", "$2,00B", "$3,00T",
    ]


def test_numbers(frame):
    nan = float("nan")
    assert values(frame, "x string", ["1.5", "abc", "", None, "NaN"], numbers.to_number("x")) == [
        1.5, None, None, None, None,
    ]
    assert values(frame, "x double", [1.0, nan, None], numbers.nan_to_null("x")) == [
        1.0, None, None,
    ]
    halves = [0.0625, 2.0005, -0.0625, 0.1235]
    assert values(frame, "x double", halves, numbers.round_half_even("x")) == [
        0.062, 2.001, -0.062, 0.124,
    ]
    assert values(frame, "x double", [0.12345, 0.0, 12.5], numbers.percent_text("x")) == [
        "12.35%", "0.00%", "1250.00%",
    ]


def test_ratio_or_zero(frame):
    df = frame("a long, b long", (1, 4), (1, 0), (None, 3), (0, 0))
    got = [r["r"] for r in df.select(numbers.ratio_or_zero("a", "b").alias("r")).collect()]
    assert got == [0.25, 0.0, 0.0, 0.0]


def test_sum_of_nothing_is_zero(frame):
    df = frame("x long", (None,))
    assert df.agg(numbers.sum_or_zero("x").alias("s")).collect()[0]["s"] == 0


def test_months(frame):
    assert periods.year_bounds(2024) == ("2024-01", "2024-12")
    for wrong in ("2024", "2024-13", "24-01", "2024-1"):
        with pytest.raises(ValueError):
            periods.parse_month(wrong)
    df = frame("y long, m long", (2020, 12), (2021, 3), (2021, 4), (2022, 1), (2022, 2))
    kept = df.where(periods.in_months("y", "m", "2021-04", "2022-01")).collect()
    assert [(r["y"], r["m"]) for r in kept] == [(2021, 4), (2022, 1)]
    first, last = periods.year_bound_columns(F.lit(2024))
    row = df.limit(1).select(first.alias("a"), last.alias("b")).collect()[0]
    assert (row["a"], row["b"]) == ("2024-01", "2024-12")
