"""Left joins on differently named keys.

Keys of the right side are dropped; its other columns get a suffix where the
left side has the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one key on the right that one task may join; hotter keys are split.
HOT_ROWS = 1_000_000
#: Keys that are looked at for being hot, and keys that a task's sketch counts.
HOT_KEYS, SKETCHED_KEYS = 256, 16_384


def _prepare(
    left: DataFrame,
    right: DataFrame,
    right_on: Sequence[str],
    suffix: str,
) -> tuple[DataFrame, list[str]]:
    """Right side without name clashes, and the names its keys now have."""
    keys = [f"__key{i}" for i in range(len(right_on))]
    renames = dict(zip(right_on, keys))
    for name in right.columns:
        if name in left.columns and name not in right_on:
            renames[name] = f"{name}{suffix}"
    return right.withColumnsRenamed(renames), keys


def _spelled(df: DataFrame, keys: Sequence[str]) -> Column:
    """The key as text, equal for equal keys; null where a part is null."""
    kinds = dict(df.dtypes)
    # 0.0 and -0.0 join, so they must be spelled alike.
    parts = [
        (F.col(k) + F.lit(0.0)).alias(f"k{i}")
        if kinds[k] in ("double", "float")
        else F.col(k).alias(f"k{i}")
        for i, k in enumerate(keys)
    ]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return F.when(whole, F.to_json(F.struct(*parts)))


def hot_keys(right: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row, ``hot``: the keys with over ``hot_rows`` rows, and into how many parts each goes.

    Every task counts its own keys in a sketch of bounded size, and only sketches
    move. A sketch may count too much but knows no key that is not there. The map
    goes from a key's hash to its text and its parts.
    """
    counted = right.select(_spelled(right, keys).alias("key")).agg(
        F.call_function(
            "approx_top_k", F.col("key"), F.lit(HOT_KEYS), F.lit(SKETCHED_KEYS)
        ).alias("top")
    )
    found = F.filter("top", lambda x: x["item"].isNotNull() & (x["count"] > hot_rows))
    parts = F.transform(
        found,
        lambda x: F.struct(
            F.xxhash64(x["item"]).alias("hash"),
            F.struct(
                x["item"].alias("key"), F.ceil(x["count"] / F.lit(hot_rows)).cast("int").alias("parts")
            ).alias("of"),
        ),
    )
    # Of two hot keys with one hash the first is split, which is enough to be right.
    alone = F.filter(
        parts, lambda x, i: ~F.exists(F.slice(parts, F.lit(1), i), lambda y: y["hash"] == x["hash"])
    )
    return counted.select(F.map_from_entries(alone).alias("hot"))


def left_join_many(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    suffix: str,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join to a table with any number of rows per key; each side is read once.

    A left outer join cannot split a hot key of its right side over several
    tasks, because each part would report its own missing match. So the hot keys
    are found first, by a sketch of the right side's key columns in a scalar
    subquery, and only they are salted: their right rows are dealt to as many
    parts as :func:`hot_keys` says, and their left rows go to every part. A hot
    key has right rows for certain, so a part of it without a match reports
    nothing. All other keys join as they are.

    Keys of different types on the two sides join by Spark's rules, unsalted.
    """
    prepared, keys = _prepare(left, right, right_on, suffix)
    condition = [F.col(a) == F.col(k) for a, k in zip(left_on, keys)]
    kinds = dict(left.dtypes)
    if [kinds[a] for a in left_on] != [t for k in keys for n, t in prepared.dtypes if n == k]:
        return left.join(prepared, condition, "left").drop(*keys)
    hot = hot_keys(prepared, keys, hot_rows).scalar()

    def parts(df: DataFrame, names: Sequence[str]) -> Column:
        """Parts of a row's key; 0 where it is not hot."""
        found = F.try_element_at(hot, F.xxhash64("__spelled"))
        return F.when(found["key"] == F.col("__spelled"), found["parts"]).otherwise(F.lit(0))

    def spelled(df: DataFrame, names: Sequence[str]) -> DataFrame:
        # Without hot keys no key needs to be spelled.
        text = F.when(F.size(hot) > 0, _spelled(df, names))
        return df.withColumn("__spelled", text).withColumn("__parts", parts(df, names)).drop("__spelled")

    # A part is never null. If it could be, Spark would ask the joins that make the
    # rows for one that is not, and evaluate the lookup there, many times per row.
    own = F.pmod(F.xxhash64(*prepared.columns), F.col("__parts")).cast("int")
    dealt = spelled(prepared, keys).withColumn(
        "__part", F.coalesce(F.when(F.col("__parts") > 1, own), F.lit(0))
    )
    dealt = dealt.drop("__parts").withColumn("__match", F.lit(True))
    every = spelled(left, left_on).withColumn(
        "__own", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__parts") - 1, F.lit(0))))
    )
    joined = every.join(dealt, [*condition, F.col("__own") == F.col("__part")], "left")
    return joined.where((F.col("__parts") == 0) | F.col("__match").isNotNull()).drop(
        *keys, "__parts", "__own", "__part", "__match"
    )


def left_join_one(
    left: DataFrame,
    right: DataFrame,
    left_on: Sequence[str],
    right_on: Sequence[str],
    suffix: str,
) -> DataFrame:
    """Left join to a table with at most one row per key.

    Only left keys can be hot then, and a left outer join splits those.
    """
    prepared, keys = _prepare(left, right, right_on, suffix)
    condition = [F.col(a) == F.col(k) for a, k in zip(left_on, keys)]
    return left.join(prepared, condition, "left").drop(*keys)
