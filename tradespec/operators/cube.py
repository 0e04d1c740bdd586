"""Queries described by a small value object instead of code."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.numbers import sum_or_zero
from tradespec.functions.periods import in_months, parse_month, year_bounds
from tradespec.operators.filters import members


@dataclass(frozen=True)
class CubeSpec:
    """Flow, inclusive months, filters, grouping details and summed metrics.

    ``data_type`` says which data the shipments are: ``general`` has no cities,
    ``cities`` has one on every row.
    """

    flow: str
    period_from: str
    period_to: str
    filters: Mapping[str, tuple] = field(default_factory=dict)
    details: tuple[str, ...] = ()
    metrics: tuple[str, ...] = ()
    month_detail: bool = False
    data_type: str = "general"

    def __post_init__(self) -> None:
        if self.flow not in ("export", "import"):
            raise ValueError(f"flow is 'export' or 'import', not {self.flow!r}")
        if self.data_type not in ("general", "cities"):
            raise ValueError(f"data_type is 'general' or 'cities', not {self.data_type!r}")
        if self.data_type == "general" and "city" in {*self.details, *self.filters}:
            raise ValueError("general data has no cities")
        parse_month(self.period_from)
        parse_month(self.period_to)

    @classmethod
    def by_city(cls, year: int, state: object) -> CubeSpec:
        """Exports of one state and year by city."""
        first, last = year_bounds(year)
        return cls(
            flow="export",
            period_from=first,
            period_to=last,
            filters={"state": (state,)},
            details=("city",),
            metrics=("metricFOB", "metricKG", "metricCIF"),
            data_type="cities",
        )


# The two ready-made queries.
STATE_HEADING_2021_2023 = CubeSpec(
    flow="export",
    period_from="2021-01",
    period_to="2023-12",
    details=("state", "heading"),
    metrics=("metricFOB",),
)
STATE_23_HEADING_2023 = CubeSpec(
    flow="export",
    period_from="2023-01",
    period_to="2023-12",
    filters={"state": ("23",)},
    details=("state", "heading"),
    metrics=("metricFOB", "metricKG", "metricCIF"),
)


def cube_query(shipments: DataFrame, spec: CubeSpec) -> DataFrame:
    """Sum the metrics per year, per month if asked, and per chosen detail.

    The shipments table has the columns ``flow``, ``year``, ``month`` and those
    named by the query. Every filter reaches the scan.
    """
    rows = shipments.where(F.col("flow") == spec.flow).where(
        in_months(names.YEAR, "month", spec.period_from, spec.period_to)
    )
    for column, values in spec.filters.items():
        rows = members(rows, column, values)
    keys = [names.YEAR, *(["month"] if spec.month_detail else []), *spec.details]
    if not spec.metrics:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(*[sum_or_zero(m).alias(m) for m in spec.metrics])
