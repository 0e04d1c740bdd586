"""Money amounts as short text with Brazilian separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradespec.functions.numbers import nan_to_null

# Thresholds and suffixes of the short money text.
SPACED_SUFFIXES = ((1e12, " Tri"), (1e9, " Bi"), (1e6, " Mi"))
TIGHT_SUFFIXES = ((1e12, "T"), (1e9, "B"), (1e6, "M"))


def money_text(
    value: Column | str,
    prefix: str = "$",
    suffixes: tuple[tuple[float, str], ...] = SPACED_SUFFIXES,
) -> Column:
    """``1234567.5`` -> ``$1,23 Mi``.

    Amounts under the smallest threshold, negative ones included, are written
    unscaled. NaN counts as null. ``prefix=""`` gives the bare number, :data:`TIGHT_SUFFIXES` the
    form without a blank before the unit. Null stays null.
    """
    c = (F.col(value) if isinstance(value, str) else value).cast("double")
    c = nan_to_null(c)
    divisor, unit = F.lit(1.0), F.lit("")
    for threshold, suffix in reversed(suffixes):
        reached = c >= F.lit(threshold)
        divisor = F.when(reached, F.lit(threshold)).otherwise(divisor)
        unit = F.when(reached, F.lit(suffix)).otherwise(unit)
    number = F.translate(F.format_number(c / divisor, 2), ",.", ".,")
    return F.concat(F.lit(prefix), number, unit)
