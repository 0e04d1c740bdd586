"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradespec.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``v, component`` for every end of ``a, b``; a component is named by its smallest end.

    In a round every end takes the name of whichever comes first in a random order,
    itself or a neighbour. Links are then renamed, and those that have become equal or
    lie within one name go, so ends that many links share meet at once and a fixed
    share of the names goes in every round, whatever the shape of the links. Each round
    is written to the scratch folder; at the end the names are followed through them.
    """
    edges = written(_distinct(links.select("a", "b")), "links")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        first = _first_neighbours(edges, len(rounds))
        names = written(first, "names")
        rounds.append(names)
        of_a = names.select(F.col("v").alias("a"), F.col("n").alias("of_a"))
        of_b = names.select(F.col("v").alias("b"), F.col("n").alias("of_b"))
        renamed = edges.join(of_a, "a").join(of_b, "b")
        edges = written(
            _distinct(renamed.select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))), "links"
        )
    if not rounds:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("component"))
    found = rounds[0]
    for names in rounds[1:]:
        further = names.select(F.col("v").alias("n"), F.col("n").alias("further"))
        found = found.join(further, "n", "left").select("v", F.coalesce("further", "n").alias("n"))
    found = written(found, "components")
    smallest = found.groupBy("n").agg(F.min("v").alias("component"))
    return found.join(smallest, "n").select("v", "component")


def _distinct(links: DataFrame) -> DataFrame:
    """Links in one direction, each once."""
    return (
        links.filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _first_neighbours(edges: DataFrame, turn: int) -> DataFrame:
    def ranked(v: str) -> Column:
        return F.struct(F.xxhash64(F.lit(turn), F.col(v)).alias("rank"), F.col(v).alias("v"))

    both = edges.select(F.col("a").alias("v"), ranked("b").alias("of")).union(
        edges.select(F.col("b").alias("v"), ranked("a").alias("of"))
    )
    first = both.groupBy("v").agg(F.min("of").alias("of"))
    return first.select("v", F.least(ranked("v"), F.col("of"))["v"].alias("n"))
