"""Exact duplicates by sorting the texts themselves.

Texts are equal when they agree after lower-casing A to Z. Cuts taken from a
sample deal the rows to key ranges; each range is sorted externally, which puts
equal texts next to each other, and every row is compared in full with the one
before it. The sort key ends with the document id, so a group of copies of any
size is cut into ranges like everything else; groups that go on over the border
of a range are put together by comparing the texts at the borders.

Defined results: null texts count as empty; empty texts equal each other; rows
repeated with the same id count in the group's size and only one of them is
kept; rows without an id are kept only where no row of the group has one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradespec.llm.common import KeyRanges, sortable, texts_of, written

_PREFIX = 16


def ascii_lower(text: Column) -> Column:
    """``text`` with A to Z in lower case and every other character as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def content_sort(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = texts_of(docs)
    norm = ascii_lower(F.col("text"))
    # The digest keeps a group together where texts share their beginning.
    key = F.concat(
        ascii_lower(F.substring("text", 1, _PREFIX)),
        F.lit("\x00"),
        F.sha2(norm, 256),
        sortable(F.col("doc_id")),
    )
    ranges = KeyRanges(rows, key)
    keyed = (
        rows.withColumn("norm", norm)
        .withColumn("text_sha256", F.sha2("norm", 256))
        .withColumn(
            "key",
            F.concat(
                F.substring("norm", 1, _PREFIX),
                F.lit("\x00"),
                F.col("text_sha256"),
                sortable(F.col("doc_id")),
            ),
        )
        .drop("text")
        .withColumn("bucket", ranges.number(F.col("key")))
        .repartition("bucket")
    )
    ordered = Window.partitionBy("bucket").orderBy("key")
    seen = ordered.rowsBetween(Window.unboundedPreceding, 0)
    compared = (
        keyed.withColumn("previous", F.lag("norm").over(ordered))
        .withColumn("is_last", F.lead("key").over(ordered).isNull())
        .withColumn("is_first", F.col("previous").isNull())
        .withColumn("is_new", (F.col("is_first") | (F.col("previous") != F.col("norm"))).cast("int"))
        .withColumn("edge", F.when(F.col("is_first") | F.col("is_last"), F.col("norm")))
        .drop("previous", "norm")
        .withColumn("run", F.sum("is_new").over(seen))
        .select("doc_id", "text_sha256", "bucket", "run", "is_first", "is_last", "edge")
    )
    table = written(compared, "content-sort")

    by_run = Window.partitionBy("bucket", "run")
    local = table.drop("edge", "is_first", "is_last").select(
        "*",
        F.max("doc_id").over(by_run).alias("run_keep"),
        F.count(F.lit(1)).over(by_run).alias("run_size"),
        F.row_number().over(by_run.orderBy(F.desc_nulls_last("doc_id"))).alias("place"),
    )
    spans = _spans(table).select(
        F.col("bucket").alias("b"), F.col("run").alias("r"), "span_keep", "span_size"
    )
    joined = local.join(
        spans, (F.col("bucket") == F.col("b")) & (F.col("run") == F.col("r")), "left"
    )
    keep = F.when(F.col("b").isNotNull(), F.col("span_keep")).otherwise(F.col("run_keep"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("span_size", "run_size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("place") == 1)).alias("kept"),
        "text_sha256",
    )


def _spans(table: DataFrame) -> DataFrame:
    """The first and last run of every range, joined with equal ones across borders.

    Two rows per range at most; the texts at the borders are compared in full.
    """
    borders = (
        table.filter("is_first or is_last")
        .groupBy("bucket")
        .agg(
            F.max(F.when(F.col("is_first"), F.col("edge"))).alias("opens"),
            F.max(F.when(F.col("is_last"), F.col("edge"))).alias("closes"),
            F.max("run").alias("last_run"),
        )
    )
    before = borders.select((F.col("bucket") + 1).alias("after"), F.col("closes").alias("ended"))
    flagged = borders.join(before, F.col("bucket") == F.col("after"), "left").select(
        "bucket",
        "last_run",
        (~F.coalesce(F.col("opens") == F.col("ended"), F.lit(False))).cast("int").alias("breaks"),
    )
    runs = flagged.select(
        "bucket",
        F.explode(
            F.when(
                F.col("last_run") > 1,
                F.array(
                    F.struct(F.lit(1).cast("long").alias("run"), F.col("breaks").alias("breaks")),
                    F.struct(F.col("last_run").alias("run"), F.lit(1).alias("breaks")),
                ),
            ).otherwise(
                F.array(F.struct(F.lit(1).cast("long").alias("run"), F.col("breaks").alias("breaks")))
            )
        ).alias("x"),
    ).select("bucket", "x.run", "x.breaks")
    # Ranges are few (see KeyRanges), so one task may number their borders.
    numbered = runs.withColumn("span", F.sum("breaks").over(Window.orderBy("bucket", "run")))
    sizes = table.groupBy("bucket", "run").agg(
        F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("size")
    )
    edges = numbered.join(sizes, ["bucket", "run"])
    totals = edges.groupBy("span").agg(
        F.max("top").alias("span_keep"), F.sum("size").alias("span_size")
    )
    return edges.join(totals, "span").select("bucket", "run", "span_keep", "span_size")
