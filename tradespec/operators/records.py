"""Filtering and rolling up the customs trade records."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradespec.functions.numbers import sum_or_zero

_LEVEL = re.compile(r"AG([1-6])")

# Filter field -> record column.
_COLUMNS = {
    "typeCode": "typeCode",
    "freqCode": "freqCode",
    "clCode": "classificationSearchCode",
    "period": "period",
    "reporterCode": "reporterCode",
    "cmdCode": "cmdCode",
    "flowCode": "flowCode",
    "partnerCode": "partnerCode",
    "partner2Code": "partner2Code",
    "customsCode": "customsCode",
    "motCode": "motCode",
}


@dataclass(frozen=True)
class RecordFilter:
    """Filter over trade records; ``None`` leaves a field unconstrained.

    Text fields take one value or a comma-separated list. ``cmdCode`` also takes
    a level: ``AG4`` stands for all 4-digit codes. ``format_output`` and
    ``breakdownMode`` are accepted but only mean something to a remote service.
    """

    typeCode: str | None = "C"
    freqCode: str | None = "A"
    clCode: str | None = "HS"
    period: str | None = "2023"
    reporterCode: str | None = None
    cmdCode: str | None = "AG4"
    flowCode: str | None = "X"
    partnerCode: str | None = "76"
    partner2Code: str | None = None
    customsCode: str | None = "C00"
    motCode: str | None = None
    maxRecords: int | None = None
    format_output: str | None = None
    aggregateBy: str | None = None
    breakdownMode: str | None = "plus"
    countOnly: bool = False
    includeDesc: bool = True

    def conditions(self) -> list[Column]:
        found = []
        for name, column in _COLUMNS.items():
            value = getattr(self, name)
            if value is not None:
                found.append(_matches(column, str(value)))
        return found


# The ready-made query of one year without second partners.
ONE_YEAR_2023 = RecordFilter(partner2Code="0")


def _matches(column: str, value: str) -> Column:
    wanted = [part.strip() for part in value.split(",")]
    if column == "period":
        return F.col(column).isin([F.lit(part).try_cast("bigint") for part in wanted])
    if column != "cmdCode":
        return F.col(column).isin(wanted)
    levels = [int(m.group(1)) for m in map(_LEVEL.fullmatch, wanted) if m]
    codes = [part for part in wanted if not _LEVEL.fullmatch(part)]
    return F.length(column).isin(levels) | F.col(column).isin(codes)


def filter_records(records: DataFrame, spec: RecordFilter) -> DataFrame:
    for condition in spec.conditions():
        records = records.where(condition)
    return records


def count_records(records: DataFrame, spec: RecordFilter) -> DataFrame:
    return filter_records(records, spec).agg(F.count("*").alias("count"))


def aggregate_records(
    records: DataFrame, spec: RecordFilter, columns: tuple[str, ...]
) -> DataFrame:
    """Value, net weight and quantity of the filtered records per chosen columns."""
    measures = ("primaryValue", "netWgt", "qty")
    return (
        filter_records(records, spec)
        .groupBy(*columns)
        .agg(*[sum_or_zero(m).alias(m) for m in measures])
    )


def query_records(records: DataFrame, spec: RecordFilter) -> DataFrame:
    """Run a filter with its output options: count, roll up, cut, drop texts."""
    if spec.countOnly:
        return count_records(records, spec)
    if spec.aggregateBy is not None:
        columns = tuple(part.strip() for part in spec.aggregateBy.split(","))
        result = aggregate_records(records, spec, columns)
    else:
        result = filter_records(records, spec)
    if not spec.includeDesc:
        result = result.drop(*[c for c in result.columns if c.endswith("Desc")])
    return result if spec.maxRecords is None else result.limit(spec.maxRecords)
