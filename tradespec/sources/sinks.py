"""CSV writers. The result is a folder of part files, one per task."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradespec.sources.readers import QUOTING

_LOSSLESS = {
    **QUOTING,
    "header": True,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(**_LOSSLESS).csv(path)


class UnwritableText(ValueError):
    """Text that the encoding of a file cannot hold."""


def _in_latin1(column: str) -> Column:
    """The column, or an error that names it and the text."""
    text = F.col(f"`{column}`")
    told = F.concat(F.lit(f"{_UNWRITABLE} {column}: "), text)
    return F.when(text.rlike(r"[^\x00-\xff]"), F.raise_error(told)).otherwise(text).alias(column)


_UNWRITABLE = "not in Latin-1, column"


def write_stamped_latin1_csv(
    df: DataFrame, folder: str, now: datetime | None = None
) -> str:
    """Write ``comtrade_<timestamp>`` in Latin-1 under ``folder``; return its path.

    Text or a header that Latin-1 cannot hold raises :class:`UnwritableText` and
    leaves no finished file set (no ``_SUCCESS``); the check is part of the write.
    """
    stamp = (now or datetime.now()).strftime("%Y%m%d-%H%M%S")
    path = f"{folder.rstrip('/')}/comtrade_{stamp}"
    for name in df.columns:
        if any(ord(c) > 0xFF for c in name):
            raise UnwritableText(f"{_UNWRITABLE} name: {name}")
    checked = df.select(
        *[_in_latin1(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes]
    )
    try:
        checked.write.options(**_LOSSLESS).option("encoding", "ISO-8859-1").csv(path)
    except Exception as error:
        found = re.search(f"{_UNWRITABLE} .*", str(error))
        if found:
            raise UnwritableText(found.group(0)) from error
        raise
    return path
