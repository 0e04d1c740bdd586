"""Numeric helpers with the null, NaN and rounding rules the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nan_to_null(value: Column | str) -> Column:
    """Spark orders NaN above every number, so NaN is removed before comparing."""
    return F.nanvl(_col(value).cast(T.DoubleType()), F.lit(None).cast(T.DoubleType()))


def to_number(value: Column | str) -> Column:
    """Double or null; text that is no number becomes null instead of an error."""
    return F.nanvl(
        _col(value).try_cast(T.DoubleType()), F.lit(None).cast(T.DoubleType())
    )


def sum_or_zero(value: Column | str) -> Column:
    """Sum aggregate that is 0, not null, when there is nothing to add."""
    return F.coalesce(F.sum(_col(value)), F.lit(0))


def ratio_or_zero(numerator: Column | str, denominator: Column | str) -> Column:
    return F.coalesce(F.try_divide(_col(numerator), _col(denominator)), F.lit(0.0))


def round_half_even(value: Column | str, digits: int = 3) -> Column:
    """Scale, round half to even, scale back (what numpy-style rounding does)."""
    scale = float(10**digits)
    return F.rint(_col(value) * F.lit(scale)) / F.lit(scale)


def percent_text(value: Column | str, digits: int = 2) -> Column:
    """``0.1234`` -> ``12.34%``."""
    text = F.format_number(_col(value) * F.lit(100.0), digits)
    return F.concat(F.translate(text, ",", ""), F.lit("%"))
