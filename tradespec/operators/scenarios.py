"""Scenario 1 to 7 of a product, from its two RCAs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradespec import names
from tradespec.functions.numbers import nan_to_null


def scenario_number(entity: Column, country: Column) -> Column:
    """The first rule that holds decides.

    From 1 up an RCA is an advantage, from 0.5 up a potential one. Rule 6 takes
    any positive country RCA that is left, and 7 takes the rest, missing values
    included.
    """
    strong, potential = 1.0, 0.5
    entity_near = (entity >= potential) & (entity < strong)
    country_near = (country >= potential) & (country < strong)
    rules = [
        (entity >= strong) & (country >= strong),
        (entity >= strong) & (country < strong),
        (entity < strong) & (country >= strong),
        entity_near & country_near,
        entity_near & (country < potential),
        (entity < potential) & (country > 0),
    ]
    number = F.lit(7)
    for rank in range(len(rules), 0, -1):
        number = F.when(rules[rank - 1], F.lit(rank)).otherwise(number)
    return number


def scenario_text(scenario: Column | str) -> Column:
    """Official description of a scenario id."""
    c = F.col(scenario) if isinstance(scenario, str) else scenario
    pairs = [F.lit(x) for item in names.SCENARIO_TEXTS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), c)


def classify_scenarios(
    df: DataFrame,
    entity: str = names.ENTITY_RCA,
    country: str = names.COUNTRY_RCA,
) -> DataFrame:
    """Add the scenario id and its description."""
    number = scenario_number(nan_to_null(entity), nan_to_null(country))
    label = F.concat(F.lit("Cenário "), number.cast("string"))
    return df.withColumn(names.SCENARIO, label).withColumn(
        names.SCENARIO_TEXT, scenario_text(names.SCENARIO)
    )
