"""Weighted priority indices over normalized metrics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.numbers import to_number


@dataclass(frozen=True)
class Weights:
    """Weights of the metrics. They need not add up to 1 and are not rescaled
    by the linear index, so that index is not confined to 0..1."""

    entity: float = 0.4
    country: float = 0.3
    adjusted: float = 0.3
    pci: float = 0.3
    distance: float = 0.4

    @classmethod
    def named(cls, weights: Mapping[str, float]) -> Weights:
        """Weights by name; a metric that is not named has weight 0."""
        fields = cls.__dataclass_fields__
        unknown = sorted(set(weights) - set(fields))
        if unknown:
            raise ValueError(f"no such metrics: {unknown}")
        return cls(**{name: weights.get(name, 0.0) for name in fields})


def linear_priority(
    df: DataFrame, weights: Weights = Weights(), suffix: str = "_norm"
) -> DataFrame:
    """Weighted sum of the four normalized metrics, with its parts X, Y, Z, AA.

    A metric whose column is absent counts as 0. A larger distance raises this
    index; :func:`nested_priority` is the one that rewards proximity.
    """
    parts = {
        "X": (names.ENTITY_RCA, weights.entity),
        "Y": (names.COUNTRY_RCA, weights.country),
        "Z": (names.PCI, weights.pci),
        "AA": (names.DISTANCE, weights.distance),
    }

    def part(metric: str, weight: float) -> Column:
        column = f"{metric}{suffix}"
        value = F.col(column) if column in df.columns else F.lit(0.0)
        return value * F.lit(float(weight))

    weighted = df.withColumns({name: part(*spec) for name, spec in parts.items()})
    total = F.col("X") + F.col("Y") + F.col("Z") + F.col("AA")
    return weighted.withColumn(names.PRIORITY, total)


def adjusted_rca(df: DataFrame) -> DataFrame:
    """Average the entity RCA with product complexity where the RCA is above 1.

    Missing values count as 0 before the test, so a missing complexity halves
    an RCA above 1.
    """
    rca = F.coalesce(to_number(names.ENTITY_RCA), F.lit(0.0))
    pci = F.coalesce(to_number(names.PCI), F.lit(0.0))
    adjusted = F.when(rca > 1, (rca + pci) / 2).otherwise(rca)
    return df.withColumn(names.ADJUSTED_RCA, adjusted)


def nested_priority(
    df: DataFrame,
    weights: Weights = Weights(),
    use_adjusted: bool = True,
    suffix: str = "_NORM",
) -> DataFrame:
    """Priority index with a composite RCA inside it.

    The RCA weights are rescaled to add up to 1 (equal parts when all are 0).
    The composite then counts 1 against the complexity and distance weights,
    and proximity, ``1 - distance``, is what is rewarded. Missing values are 0,
    also in the normalized complexity column of the result.
    """
    rca_weights = {names.ENTITY_RCA: weights.entity, names.COUNTRY_RCA: weights.country}
    if use_adjusted:
        rca_weights[names.ADJUSTED_RCA] = weights.adjusted
    rca_total = sum(rca_weights.values())
    if rca_total > 0:
        rca_weights = {m: w / rca_total for m, w in rca_weights.items()}
    else:
        rca_weights = {m: 1 / len(rca_weights) for m in rca_weights}
    group_total = 1 + weights.pci + weights.distance

    def filled(metric: str) -> Column:
        return F.coalesce(to_number(f"{metric}{suffix}"), F.lit(0.0))

    composite = F.lit(0.0)
    for metric, weight in rca_weights.items():
        composite = composite + filled(metric) * F.lit(weight)
    index = (
        composite * F.lit(1 / group_total)
        + filled(names.PCI) * F.lit(weights.pci / group_total)
        + (F.lit(1.0) - filled(names.DISTANCE)) * F.lit(weights.distance / group_total)
    )
    return df.withColumns(
        {names.PRIORITY: index, f"{names.PCI}{suffix}": filled(names.PCI)}
    )


def ranked(df: DataFrame, by: str = names.PRIORITY, tie: str = names.CODE) -> DataFrame:
    """Highest first, missing last, ties by code."""
    return df.orderBy(F.col(by).desc_nulls_last(), F.col(tie))
