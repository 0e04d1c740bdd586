"""Report on a selection of states, years and products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.money import money_text
from tradespec.functions.numbers import round_half_even
from tradespec.operators.filters import Selection
from tradespec.operators.rca import selection_rca
from tradespec.operators.summaries import (
    heading_shares,
    headline_numbers,
    lump_small,
)
from tradespec.plans.comparison import with_headers


def selection_table(exports: DataFrame, selection: Selection) -> DataFrame:
    """RCA per state and product of the selection, highest first.

    The national side is the whole exports table, not narrowed by the
    selection, whichever years or products are picked.
    """
    rca = selection_rca(selection.apply(exports), exports)
    return rca.orderBy(F.col("VCR").desc_nulls_last(), names.STATE, names.CODE)


def selection_view(table: DataFrame) -> DataFrame:
    """Display form: money as text, RCA with three digits, display names."""
    shown = table.withColumns(
        {names.FOB: money_text(names.FOB), "VCR": round_half_even("VCR")}
    )
    return with_headers(shown, names.SELECTION_HEADERS)


def selection_bars(
    exports: DataFrame, selection: Selection, threshold: float = names.SMALL_SHARE
) -> DataFrame:
    """Value per description and state, small shares lumped, largest first."""
    bars = lump_small(heading_shares(selection.apply(exports)), threshold)
    return bars.orderBy(
        F.col(names.FOB).desc_nulls_last(), names.HEADING, names.STATE
    )


def selection_report(
    exports: DataFrame, selection: Selection
) -> dict[str, DataFrame]:
    """Headline numbers, RCA table and bars of one selection."""
    return {
        "headline": headline_numbers(exports, selection),
        "table": selection_view(selection_table(exports, selection)),
        "bars": selection_bars(exports, selection),
    }
