import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import EXPORTS, as_set, by_key
from tradespec.operators.rca import entity_and_whole_sums, entity_rca, selection_rca


def test_entity_rca_by_hand(frame):
    exports = frame(
        EXPORTS,
        (2023, "Ceará", "0101", "a", 30),
        (2023, "Ceará", "0102", "b", 10),
        (2023, "Bahia", "0101", "a", 30),
        (2023, "Bahia", "0103", "c", 130),
        (2023, "Bahia", "0104", "d", 0),
        (2023, "Bahia", "0104", "d", -7),
        (2023, "Bahia", "0105", "e", None),
    )
    # Entity total 40, whole total 200.
    assert by_key(entity_rca(exports), "headingCode", "VCR_Ceara_Brasil") == pytest.approx(
        {"0101": (30 / 40) / (60 / 200), "0102": (10 / 40) / (10 / 200), "0103": 0.0}
    )


def test_rows_without_state_or_code_count_in_totals_only(frame):
    exports = frame(
        EXPORTS,
        (2023, "Ceará", "0101", "a", 50),
        (2023, "Ceará", None, None, 50),
        (2023, None, "0101", "a", 100),
    )
    got = by_key(entity_rca(exports), "headingCode", "VCR_Ceara_Brasil")
    assert got == pytest.approx({"0101": (50 / 100) / (150 / 200)})


def test_no_rows_without_an_entity_total(frame):
    exports = frame(EXPORTS, (2023, "Bahia", "0101", "a", 5))
    assert entity_rca(exports).collect() == []
    assert entity_rca(exports.where("false")).collect() == []
    only_negative = frame(EXPORTS, (2023, "Ceará", "0101", "a", -5))
    assert entity_rca(only_negative).collect() == []


def test_padding_brings_codes_together(frame):
    exports = frame(
        EXPORTS, (2023, "Ceará", "101", "a", 5), (2023, "Bahia", "0101", "a", 5)
    )
    assert by_key(entity_rca(exports, pad=4), "headingCode", "VCR_Ceara_Brasil") == {"0101": 2.0 / 2}
    assert set(by_key(entity_rca(exports), "headingCode", "VCR_Ceara_Brasil")) == {"101", "0101"}


def test_conditional_sums_equal_a_full_outer_join(frame):
    exports = frame(
        EXPORTS,
        *[
            (2023, state, f"{code:04d}", "h", (code * 37 + len(state)) % 50)
            for code in range(20)
            for state in ("Ceará", "Bahia", "Pará")
            if (code + len(state)) % 3
        ],
    )
    positive = exports.where("metricFOB > 0")
    entity = positive.where(F.col("state") == "Ceará").groupBy("headingCode").agg(F.sum("metricFOB").alias("e"))
    whole = positive.groupBy("headingCode").agg(F.sum("metricFOB").alias("w"))
    joined = entity.join(whole, "headingCode", "full_outer").na.fill(0)
    ours = entity_and_whole_sums(exports).where("whole_value is not null").na.fill(0)
    assert as_set(ours, "headingCode", "entity_value", "whole_value") == as_set(
        joined, "headingCode", "e", "w"
    )


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from(["Ceará", "Bahia", None]),
            st.sampled_from(["0101", "0102", "0103"]),
            st.integers(-5, 1000),
        ),
        min_size=1,
        max_size=12,
    )
)
def test_shares_weighted_by_rca_add_up_to_one(frame, rows):
    """The whole's shares times the entity's RCA are the entity's shares."""
    exports = frame(EXPORTS, *[(2023, s, c, "h", v) for s, c, v in rows])
    rca = by_key(entity_rca(exports), "headingCode", "VCR_Ceara_Brasil")
    whole = {}
    for _, code, value in rows:
        if value > 0:
            whole[code] = whole.get(code, 0) + value
    if rca:
        total = sum(whole.values())
        assert sum(rca[c] * whole[c] / total for c in rca) == pytest.approx(1.0)
    else:
        assert not any(s == "Ceará" and v > 0 for s, _, v in rows)


NATIONAL = [
    (2022, "Ceará", "0101", "a", 10),
    (2023, "Ceará", "0101", "a", 30),
    (2023, "Ceará", "0102", "b", 20),
    (2023, "Bahia", "0101", "a", 40),
    (2023, "Bahia", "0102", "b2", 60),
    (2023, "Pará", "0103", "c", 40),
]


def test_one_state_is_compared_with_the_whole_table(frame):
    national = frame(EXPORTS, *NATIONAL)
    selected = national.where("state = 'Ceará' and year = 2023")
    got = as_set(selection_rca(selected, national), "state", "headingCode", "heading", "metricFOB", "VCR")
    # The baseline keeps 2022 although the selection is 2023 only: total 200.
    vcr_1 = (30 / 50) / (80 / 200)
    vcr_2 = (20 / 50) / (80 / 200)
    assert got == {
        ("Ceará", "0101", "a", 30, vcr_1),
        ("Ceará", "0102", "b", 20, vcr_2),
        ("Ceará", "0102", "b2", 20, vcr_2),
    }


def test_several_states_are_compared_with_each_other(frame):
    national = frame(EXPORTS, *NATIONAL)
    selected = national.where("state in ('Ceará', 'Bahia') and year = 2023")
    got = as_set(selection_rca(selected, national), "state", "headingCode", "VCR")
    assert got == {
        ("Ceará", "0101", (30 / 50) / (70 / 150)),
        ("Ceará", "0102", (20 / 50) / (80 / 150)),
        ("Bahia", "0101", (40 / 100) / (70 / 150)),
        ("Bahia", "0102", (60 / 100) / (80 / 150)),
    }


def test_a_missing_state_counts_as_a_second_state(frame):
    national = frame(EXPORTS, *NATIONAL, (2023, None, "0101", "a", 50))
    selected = national.where("state = 'Ceará' or state is null").where("year = 2023")
    got = as_set(selection_rca(selected, national), "state", "headingCode", "heading", "VCR")
    assert ("Ceará", "0101", "a", (30 / 50) / (80 / 100)) in got
    assert all(state == "Ceará" for state, *_ in got)


def test_only_positive_rcas_are_kept(frame):
    national = frame(
        EXPORTS,
        (2023, "Ceará", "0101", "a", 10),
        (2023, "Ceará", "0102", "b", 0),
        (2023, "Ceará", "0103", "c", None),
    )
    got = as_set(selection_rca(national, national), "headingCode", "VCR")
    assert got == {("0101", 1.0)}


def test_empty_selection_gives_no_rows(frame):
    national = frame(EXPORTS, *NATIONAL)
    result = selection_rca(national.where("state = 'Acre'"), national)
    assert result.collect() == []
    assert result.columns == ["state", "headingCode", "heading", "metricFOB", "VCR"]


def test_zero_baseline_gives_zero_for_every_pair(frame):
    national = frame(
        EXPORTS,
        (2023, "Ceará", "0101", "a", 5),
        (2023, "Ceará", "0102", "b", -5),
        (2023, "Bahia", "0101", "a", 0),
    )
    for selected in (national, national.where("state = 'Ceará'")):
        got = as_set(selection_rca(selected, national), "state", "headingCode", "VCR")
        pairs = as_set(selected, "state", "headingCode")
        assert got == {(s, c, 0.0) for s, c in pairs}


def test_a_hot_product_and_state_keep_their_results(frame):
    """A third of all rows under one pair changes nothing but the counts."""
    rows = [(2023, "Ceará", "0101", "a", 1)] * 300
    rows += [(2023, f"S{i % 20}", f"{i % 40:04d}", f"h{i % 40}", 1) for i in range(600)]
    exports = frame(EXPORTS, *rows)
    got = by_key(entity_rca(exports), "headingCode", "VCR_Ceara_Brasil")
    assert got["0101"] == pytest.approx((300 / 300) / (300 / 900))
    assert len(got) == 41
