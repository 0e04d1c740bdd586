"""Months are ``YYYY-MM`` texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTH = re.compile(r"([0-9]{4})-(0[1-9]|1[0-2])")


def year_bounds(year: int) -> tuple[str, str]:
    """First and last month of a year."""
    return f"{year:04d}-01", f"{year:04d}-12"


def year_bound_columns(year: Column | str) -> tuple[Column, Column]:
    """The same for a column of years."""
    c = F.col(year) if isinstance(year, str) else year
    text = F.lpad(c.cast("string"), 4, "0")
    return F.concat(text, F.lit("-01")), F.concat(text, F.lit("-12"))


def parse_month(text: str) -> tuple[int, int]:
    found = _MONTH.fullmatch(text)
    if found is None:
        raise ValueError(f"expected a month as YYYY-MM, got {text!r}")
    return int(found.group(1)), int(found.group(2))


def in_months(
    year: Column | str, month: Column | str, first: str, last: str
) -> Column:
    """Rows whose (year, month) lies in the inclusive range.

    The plain comparison on the year comes first so that it can prune files or
    partitions; the combined one settles the months at both ends.
    """
    y = F.col(year) if isinstance(year, str) else year
    m = F.col(month) if isinstance(month, str) else month
    (y0, m0), (y1, m1) = parse_month(first), parse_month(last)
    return y.between(y0, y1) & (y * 100 + m).between(y0 * 100 + m0, y1 * 100 + m1)
