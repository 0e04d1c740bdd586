"""Report on the trade records of chosen years and products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec.operators.filters import members
from tradespec.operators.summaries import value_by_description


def chosen_records(
    trade_records: DataFrame, years: Sequence[int] = (), codes: Sequence[str] = ()
) -> DataFrame:
    """The records of the years and product codes; an empty choice keeps all."""
    rows = trade_records
    for column, values in (("refYear", years), ("cmdCode", codes)):
        if values:
            rows = members(rows, column, tuple(values))
    return rows


def records_report(
    trade_records: DataFrame, years: Sequence[int] = (), codes: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """``table``: the chosen records; ``shares``: value and share per description,
    largest first."""
    rows = chosen_records(trade_records, years, codes)
    shares = value_by_description(rows)
    return {
        "table": rows,
        "shares": shares.orderBy(F.col("primaryValue").desc_nulls_last(), "cmdDesc"),
    }
