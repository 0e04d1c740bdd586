"""Helpers shared by the operators: scratch tables, key ranges, expressions."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one key range holds on average, and the most ranges there are.
RANGE_ROWS = 512
MAX_RANGES = 16_384
_FANOUT = 128


def scratch_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tradespec-llm-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table of the scratch folder and read again."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, null texts as empty ones."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def is_held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once although used several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sortable(number: Column) -> Column:
    """A long as 16 characters in the same order; null as the empty text."""
    flipped = number.bitwiseXOR(F.lit(-(2**63)))
    return F.coalesce(F.lpad(F.hex(flipped), 16, "0"), F.lit(""))


class KeyRanges:
    """Ranges of a text key, cut at keys that a sample of the rows holds.

    Every range starts with a key that exists, so none is empty. The keys sent
    to the driver are ``OVERSAMPLED`` for each range, of which there are
    :data:`MAX_RANGES` at most.
    """

    OVERSAMPLED = 12

    def __init__(self, df: DataFrame, key: Column, rows_each: int = RANGE_ROWS):
        rows = df.count()
        ranges = max(1, min(MAX_RANGES, -(-rows // rows_each)))
        keys: list[str] = []
        first = None
        if rows:
            share = min(1.0, self.OVERSAMPLED * ranges / rows)
            keyed = df.select(key.alias("k"))
            first = keyed.agg(F.min("k")).first()[0]
            if ranges > 1:
                sampled = (
                    df.sample(fraction=share, seed=11).select(key.alias("k")).limit(
                        2 * self.OVERSAMPLED * ranges
                    )
                )
                keys = sorted({r.k for r in sampled.collect()} - {first})
        step = max(1, round(len(keys) / ranges))
        self.cuts = keys[step - 1 :: step] if ranges > 1 else []
        self.first = first
        self.count = len(self.cuts) + 1

    def _groups(self) -> Column:
        groups = [self.cuts[i : i + _FANOUT] for i in range(0, len(self.cuts), _FANOUT)]
        return F.from_json(F.lit(json.dumps(groups)), "array<array<string>>")

    def number(self, key: Column) -> Column:
        """The range of a key, from 0: how many cuts are not above it."""
        if not self.cuts:
            return F.lit(0)
        tops = self.cuts[::_FANOUT]
        heads = F.from_json(F.lit(json.dumps(tops)), "array<string>")

        def inside(at: Column) -> Column:
            return F.when(at == 0, F.lit(0)).otherwise(
                (at - 1) * _FANOUT
                + F.size(F.filter(F.element_at(self._groups(), at), lambda s: s <= key))
            )

        return let(F.size(F.filter(heads, lambda s: s <= key)), inside)

    def starts(self, key: Column, number: Column) -> Column:
        """Whether a key is the first of its range ``number``."""
        opening = F.from_json(F.lit(json.dumps([self.first, *self.cuts])), "array<string>")
        return F.element_at(opening, number + 1) == key
