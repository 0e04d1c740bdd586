"""Min-max normalization."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec.functions.numbers import nan_to_null, to_number

_BOUNDS = "__bounds"


def min_max(
    df: DataFrame,
    columns: Sequence[str],
    suffix: str = "_norm",
    coerce: bool = False,
) -> DataFrame:
    """Add ``(x - min) / (max - min)`` for each column; 0.0 throughout when all
    values are equal.

    The bounds of all columns are one aggregate row used as a subquery. Missing
    values are skipped in the bounds and stay missing. With ``coerce``, text
    columns are read as numbers where they are numbers, and a column without
    any number is normalized to 0.0 throughout.

    Bounds and values are two evaluations of ``df``. If it adds up doubles, the
    two may differ in the last bit, so results are kept within 0 and 1.
    """
    numeric = {c: to_number(c) if coerce else nan_to_null(c) for c in columns}
    bounds = df.agg(
        F.struct(
            *[
                F.struct(F.min(x).alias("low"), F.max(x).alias("high")).alias(c)
                for c, x in numeric.items()
            ]
        ).alias(_BOUNDS)
    ).scalar()
    added = {}
    for c, x in numeric.items():
        low, high = F.col(f"{_BOUNDS}.{c}.low"), F.col(f"{_BOUNDS}.{c}.high")
        flat = high == low
        if coerce:
            flat = flat | low.isNull()
        scaled = F.try_divide(x - low, high - low)
        added[f"{c}{suffix}"] = (
            F.when(flat, F.lit(0.0))
            .when(scaled < 0, F.lit(0.0))
            .when(scaled > 1, F.lit(1.0))
            .otherwise(scaled)
        )
    # One struct column, so that the subquery is planned once.
    return df.withColumn(_BOUNDS, bounds).withColumns(added).drop(_BOUNDS)
