"""Row filters. An empty or absent selection never filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.codes import exactly_digits


def positive_values(df: DataFrame, value: str = names.FOB) -> DataFrame:
    return df.where(F.col(value) > 0)


def equal_to(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def latest(df: DataFrame, column: str = names.YEAR) -> DataFrame:
    """Rows of the highest year. The maximum is a subquery, so the scan of the
    main branch gets it as a filter and skips other partitions or row groups."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())


def in_list(column: Column | str, values: Sequence | None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isin(list(values)) if values else F.lit(True)


def among(df: DataFrame, column: str, values: Sequence) -> Column:
    """Whether a column is one of the values.

    They take the column's type, never the other way round: the filter stays one
    that a scan can use, and a value of another type cannot fail.
    """
    kind = df.schema[column].dataType
    return F.col(column).isin([F.lit(v).try_cast(kind) for v in values])


def members(
    df: DataFrame, column: str, values: Sequence | DataFrame | None
) -> DataFrame:
    """Keep rows whose ``column`` is among ``values``.

    A list becomes an IN filter that reaches the scan. A list too long to live
    in a query plan comes as a one-column DataFrame and becomes a semi join; its
    duplicates go first, since that side of the join cannot be split by key.
    """
    if isinstance(values, DataFrame):
        (key,) = values.columns
        wanted = values.select(F.col(key).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    if not values:
        return df
    return df.where(among(df, column, values))


def code_between(
    df: DataFrame,
    first: str | None = None,
    last: str | None = None,
    column: str = names.CODE,
) -> DataFrame:
    """Inclusive range in string order; ``None`` leaves that end open."""
    if first is not None:
        df = df.where(F.col(column) >= first)
    if last is not None:
        df = df.where(F.col(column) <= last)
    return df


def valid_heading(column: str = names.CODE) -> Column:
    """True for a usable heading code: present, not ``"0"``, longer than one."""
    c = F.col(column)
    return c.isNotNull() & (c != "0") & (F.length(c) > 1)


def valid_headings(df: DataFrame, column: str = names.CODE) -> DataFrame:
    return df.where(valid_heading(column))


def four_digit_codes(df: DataFrame, column: str) -> DataFrame:
    return df.where(exactly_digits(column, 4))


def client_rows(
    bridge: DataFrame,
    product_codes: Sequence | DataFrame,
    activity_codes: Sequence | DataFrame | None = None,
) -> DataFrame:
    """Correspondence rows of one client: its products, and its activities if given."""
    if isinstance(product_codes, DataFrame) or product_codes:
        kept = members(bridge, "ncm8", product_codes)
    else:
        kept = bridge.where(F.lit(False))  # a client without products has no rows
    return members(kept, "cnae7", activity_codes)


@dataclass(frozen=True)
class Selection:
    """What a user picked over the exports table; an empty tuple means everything."""

    states: tuple[str, ...] = field(default=())
    years: tuple[int, ...] = field(default=())
    products: tuple[str, ...] = field(default=())

    def condition(self, table: DataFrame) -> Column:
        """The values take the types of the table's columns; one that has no such type
        selects nothing and does not fail."""
        chosen = (
            (names.STATE, self.states),
            (names.YEAR, self.years),
            (names.CODE, self.products),
        )
        return reduce(
            and_, (among(table, c, values) for c, values in chosen if values), F.lit(True)
        )

    def apply(self, exports: DataFrame) -> DataFrame:
        return exports.where(self.condition(exports))
