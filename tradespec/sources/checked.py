"""CSV tables with the cells that did not fit their type, found in the same read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradespec.sources.readers import QUOTING

#: What is wrong with a rejected cell.
UNFIT, INFINITE, SURPLUS = "unfit", "infinite", "surplus"
_RECORD = "__record"


@dataclass(frozen=True)
class CheckedTable:
    """A lenient table, its rejected cells, and counts that an action on the table gives.

    ``table`` has the rows of the lenient reader. ``rejects`` has one row for each
    cell that was lost: ``column``, ``text`` and ``reason``, and ``record``, the line
    as it stands in the file; it is a query of its own. ``counts`` is filled by the
    first action on ``table``, such as writing it, without another read: ``rows``,
    ``rejected_rows`` and ``rejected_cells``.
    """

    table: DataFrame
    rejects: DataFrame
    counts: Observation


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


def _lost(schema: T.StructType, cells: Column) -> Column:
    """The lost cells of a record, whose texts are ``cells``, as an array of structs."""

    def lost(column: str | None, text: Column, reason: str) -> Column:
        return F.struct(
            F.lit(column).cast("string").alias("column"),
            text.alias("text"),
            F.lit(reason).alias("reason"),
        )

    found = []
    for i, field in enumerate(schema):
        typed, text = F.col(f"`{field.name}`"), cells[f"c{i}"]
        judged = F.when(typed.isNull() & text.isNotNull(), lost(field.name, text, UNFIT))
        if _is_number(field):
            shown = F.coalesce(text, typed.cast("string"))
            endless = F.abs(typed) == F.lit(float("inf"))
            judged = judged.when(endless, lost(field.name, shown, INFINITE))
        found.append(judged)
    found.append(F.when(cells["rest"].isNotNull(), lost(None, cells["rest"], SURPLUS)))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def read_checked_csv(
    spark: SparkSession,
    path: str,
    schema: str | T.StructType,
    encoding: str = "UTF-8",
    multi_line: bool = False,
) -> CheckedTable:
    """The table of :func:`tradespec.sources.readers.read_typed_csv`, and what it lost.

    A cell is lost if it holds text but the typed column is null (``unfit``), or if
    it is an infinite number, as one too large for its type becomes (``infinite``;
    its text is kept only where the parser objected to the record as well). A field
    after the last column is lost too (``surplus``, with no column; of several such
    fields the first is named). Records with too few fields lose no text.

    The parser keeps the record where something does not fit; only such records
    are split a second time, as text.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if _RECORD in kind.names:
        raise ValueError(f"{_RECORD} is a reserved name")
    read = spark.read.csv(
        path,
        schema=T.StructType([*kind, T.StructField(_RECORD, T.StringType())]),
        header=True,
        mode="PERMISSIVE",
        columnNameOfCorruptRecord=_RECORD,
        encoding=encoding,
        multiLine=multi_line,
        **QUOTING,
    )
    texts = ", ".join([f"c{i} STRING" for i in range(len(kind))] + ["rest STRING"])
    cells = F.when(F.col(_RECORD).isNotNull(), F.from_csv(_RECORD, texts, QUOTING))
    split = read.withColumn("__cells", cells)
    judged = split.withColumn("__lost", _lost(kind, F.col("__cells"))).drop("__cells")
    counts = Observation()
    some = F.size("__lost") > 0
    observed = judged.observe(
        counts,
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(some.cast("long")), F.lit(0)).alias("rejected_rows"),
        F.coalesce(F.sum(F.size("__lost").cast("long")), F.lit(0)).alias("rejected_cells"),
    )
    rejects = judged.select(F.col(_RECORD).alias("record"), F.explode("__lost").alias("cell"))
    return CheckedTable(
        observed.select(*[F.col(f"`{f.name}`") for f in kind]),
        rejects.select("cell.column", "cell.text", "cell.reason", "record"),
        counts,
    )
