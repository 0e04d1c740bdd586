"""Hard negatives for contrastive training, scored exactly by Kronecker-packed products.

Vectors become integers, ``floor(256 * x)`` per component. A block of candidates is
packed dimension by dimension: every candidate's component, biased to be positive, is
a field of one wide integer. To score an anchor against a block, that integer is
multiplied once by the anchor's biased component, for each dimension, and the products
are added up; a field is wide enough that none carries into the next. The fields then
hold the inner products of the biased vectors, and what the bias added is taken off
with the sums of the components. The scores are exact.

Anchors are a stated query set; they meet all rows block by block. First each anchor
meets the rows of its own label for the positives, then all rows for the negatives. A
pair of blocks keeps only what can still be among the first ones, and a window over
those gives the answer. Blocks are dealt by a hash of the row, so a label or an id
that many rows share fills many blocks.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part. Higher scores come first, ties by smaller id, rows without an
id last. Repeated rows, also with one id, are rows of their own; an anchor is not its
own positive, yet a copy of it is. Vectors of different lengths are never compared;
those of length 0 all score 0. Components beyond 2^12 in size count as 2^12, so that
scores fit a long. A positive with a score below 0 has no negatives, since its band is
empty. Columns other than the three named are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradespec.llm.common import written

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
BAND = (30, 90)
#: Rows and anchors that meet at once.
BLOCK, ANCHORS = 2048, 512
BOUND = 1 << 20


def quantized(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rid, vec_id, label, dims, q``: the rows that take part, components as integers."""

    def whole(x: Column) -> Column:
        x = F.floor(F.lit(256.0) * x.cast("double"))
        return F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), x)).cast("int")

    def sound(x: Column) -> Column:
        x = x.cast("double")
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    return (
        vectors.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("label").cast("long").alias("label"),
            F.col(vector).alias("vector"),
        )
        .filter(F.col("label").isNotNull() & F.col("vector").isNotNull())
        .filter(F.forall("vector", sound))
        .select("rid", "vec_id", "label", F.size("vector").alias("dims"), F.transform("vector", whole).alias("q"))
    )


class Packed:
    """Integer vectors, their components in each dimension as fields of one wide integer."""

    def __init__(self, rows: np.ndarray, largest: int):
        """``largest`` is the size that no component of the rows or an anchor exceeds."""
        self.count, self.dims = rows.shape
        self.bias, self.sums = largest, rows.sum(axis=1)
        most = (2 * largest) ** 2 * max(1, self.dims)
        self.bytes = 4 if most < 1 << 32 else 8
        fields = np.ascontiguousarray((rows + largest).T).astype(f"<u{self.bytes}")
        self.wide = [int.from_bytes(f.tobytes(), "little") for f in fields]

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products of one anchor with all rows."""
        total = 0
        for component, wide in zip((anchor + self.bias).tolist(), self.wide):
            total += component * wide
        fields = np.frombuffer(total.to_bytes(self.count * self.bytes, "little"), f"<u{self.bytes}")
        added = self.bias * (self.sums + int(anchor.sum())) + self.bias**2 * self.dims
        return fields.astype(np.int64) - added


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), dims)


def _first(order: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Of places in the order of ties, those of the ``most`` highest scores, best first."""
    if len(order) > most:
        least = np.partition(scores[order], len(order) - most)[len(order) - most]
        order = order[scores[order] >= least]
    return order[np.argsort(-scores[order], kind="stable")][:most]


def _dealt(rows: DataFrame, keys: list[str], size: int, part: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their block of ``size`` among those that share ``keys``, and the block counts."""
    counts = rows.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias(f"{part}s")
    )
    dealt = rows.join(counts, keys).withColumn(
        part, F.pmod(F.xxhash64("rid"), F.col(f"{part}s")).cast("int")
    )
    return dealt.drop(f"{part}s"), counts


def _met(anchors: DataFrame, rows: DataFrame, keys: list[str], keep, schema: str) -> DataFrame:
    """What ``keep`` says of every block of anchors and block of rows that share ``keys``."""
    asking, asked_by = _dealt(anchors, keys, ANCHORS, "a_part")
    # New names for the same columns: anchors are some of the rows themselves.
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])
    asked, asked_of = _dealt(rows, keys, BLOCK, "part")

    def beside(side: DataFrame, other: DataFrame, part: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.col(f"{part}s") - 1)).alias(part)
        return side.join(other, keys).select(*side.columns, every)

    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return fields.empty_table()
        # Ties go by id, rows without one last.
        right = right.sort_by([("vec_id", "ascending"), ("rid", "ascending")])
        dims = left["dims"][0].as_py()
        mine, theirs = _matrix(left["q"], dims), _matrix(right["q"], dims)
        packed = Packed(theirs, int(max(np.abs(mine).max(initial=0), np.abs(theirs).max(initial=0))))
        ids = right["vec_id"].to_pylist()
        rids, labels = right["rid"].to_numpy(), right["label"].to_numpy()
        found: list[tuple] = []
        for anchor, vector in zip(left.drop_columns("q").to_pylist(), mine):
            scores = packed.scores(vector)
            for place, tag in keep(anchor, rids, labels, scores):
                row = (anchor["rid"], tag, int(rids[place]), ids[place], int(scores[place]))
                found.append(row)
        columns = zip(*found) if found else [()] * len(fields)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    blocks = [*keys, "a_part", "part"]
    return (
        beside(asking, asked_of, "part")
        .groupBy(*blocks)
        .cogroup(beside(asked, asked_by, "a_part").groupBy(*blocks))
        .applyInArrow(run, schema)
    )


def _same_label(anchor: dict, rids: np.ndarray, labels: np.ndarray, scores: np.ndarray):
    for place in _first(np.flatnonzero(rids != anchor["rid"]), scores, POSITIVES):
        yield place, 0


def _in_band(anchor: dict, rids: np.ndarray, labels: np.ndarray, scores: np.ndarray):
    other, hundredfold = labels != anchor["label"], 100 * scores
    kept: dict[int, np.ndarray] = {}
    for rank, positive in enumerate(anchor["positives"], 1):
        if positive not in kept:
            low, high = BAND[0] * positive, BAND[1] * positive
            band = np.flatnonzero(other & (low <= hundredfold) & (hundredfold <= high))
            kept[positive] = _first(band, scores, NEGATIVES)
        for place in kept[positive]:
            yield place, rank


def _ranked(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("a_rid", "tag").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), F.asc("rid")
    )
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def mine(vectors: DataFrame, anchors: Column, vector: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` says which rows of ``vectors`` (``vec_id``, ``label`` and the vector) are
    anchors.
    """
    found = "a_rid long, tag int, rid long, vec_id long, score long"
    # Row numbers are drawn once: the table is written before it is read several times.
    rows = written(quantized(vectors, vector), "vectors")
    asking = rows.filter(anchors)
    positives = written(
        _ranked(_met(asking, rows, ["dims", "label"], _same_label, found), POSITIVES).select(
            "a_rid",
            F.col("rank").alias("tag"),
            F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
        ),
        "positives",
    )
    # At most POSITIVES of each anchor.
    listed = positives.groupBy(F.col("a_rid").alias("rid")).agg(
        F.sort_array(F.collect_list(F.struct("tag", "positive_score"))).alias("of")
    )
    judged = asking.join(listed, "rid").select(
        *asking.columns, F.col("of.positive_score").alias("positives")
    )
    negatives = _ranked(_met(judged, rows, ["dims"], _in_band, found), NEGATIVES)
    named = asking.select(F.col("rid").alias("a_rid"), F.col("vec_id").alias("anchor_id"))
    return (
        negatives.join(positives, ["a_rid", "tag"])
        .join(named, "a_rid")
        .select(
            "anchor_id",
            "positive_id",
            "rank",
            F.col("vec_id").alias("negative_id"),
            "positive_score",
            F.col("score").alias("negative_score"),
        )
    )


def relabelled(vectors: DataFrame) -> DataFrame:
    """Labels moved on by one, modulo 10, where the id is divisible by 7."""
    moved = (F.col("label") + 1) % 10
    return vectors.withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, moved).otherwise(F.col("label"))
    )
