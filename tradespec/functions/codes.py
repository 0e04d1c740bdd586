"""Product and activity codes are strings; these helpers clean them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def zero_pad(code: Column | str, width: int) -> Column:
    """Left-pad with zeros; a code already longer than ``width`` is kept whole."""
    c = _col(code)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def code_prefix(code: Column | str, length: int = 4) -> Column:
    return F.substring(_col(code), 1, length)


def strip_decimal_suffix(code: Column | str) -> Column:
    """Undo a code that went through a float column: ``1012100.0`` -> ``1012100``."""
    return F.regexp_replace(_col(code), r"\.0$", "")


def strip_code_marks(code: Column | str) -> Column:
    """Drop dots, dashes and blanks from an activity code."""
    return F.trim(F.regexp_replace(_col(code), r"[. -]", ""))


def all_digits(code: Column | str) -> Column:
    return _col(code).rlike("^[0-9]+$")


def exactly_digits(code: Column | str, count: int = 4) -> Column:
    return _col(code).rlike(f"^[0-9]{{{count}}}$")


def option_label(code: Column | str, text: Column | str, length: int = 50) -> Column:
    """``code - first characters of the text...``; null when either is null."""
    return F.concat(
        _col(code), F.lit(" - "), F.substring(_col(text), 1, length), F.lit("...")
    )


def code_from_label(label: Column | str) -> Column:
    return F.substring_index(_col(label), " - ", 1)
