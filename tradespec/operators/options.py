"""Reference lists: what a user can choose from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.codes import option_label, zero_pad
from tradespec.operators.filters import Selection


def heading_reference(exports: DataFrame, pad: int | None = 4) -> DataFrame:
    """Distinct (code, description).

    Codes are padded before duplicates are dropped. A code with several
    descriptions keeps one row for each, so a join on the code fans out.
    """
    code = zero_pad(names.CODE, pad) if pad else F.col(names.CODE)
    return exports.select(code.alias(names.CODE), names.HEADING).distinct()


def distinct_options(
    df: DataFrame, column: str, as_type: str | None = None
) -> DataFrame:
    """Distinct values of a column without nulls, cast if asked, in order."""
    value = F.col(column).try_cast(as_type) if as_type else F.col(column)
    options = df.select(value.alias(column)).where(F.col(column).isNotNull())
    return options.distinct().orderBy(column)


def default_option(df: DataFrame, column: str, preferred: object) -> DataFrame:
    """One row: the preferred value if it occurs, else the first in order."""
    c = F.col(column)
    found = F.max(F.when(c == F.lit(preferred), c))
    return df.agg(F.coalesce(found, F.min(c)).alias(column))


def product_options(
    exports: DataFrame, states: Sequence[str] = (), years: Sequence[int] = ()
) -> DataFrame:
    """Distinct ``code - description...`` labels left after the state and year choice."""
    chosen = Selection(states=tuple(states), years=tuple(years)).apply(exports)
    label = option_label(names.CODE, names.HEADING).alias("HS_Desc")
    labels = chosen.select(label).where(F.col("HS_Desc").isNotNull())
    return labels.distinct().orderBy("HS_Desc")
