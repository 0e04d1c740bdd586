"""Document fingerprints by winnowing.

A text's tokens (runs of letters and digits, single ideographs; lower case; in a
text without any, its characters) are hashed in overlapping k-grams. Of every ``window``
consecutive hashes the smallest is chosen, the rightmost one of equals, and its
position kept. Two texts that share ``window + k - 1`` consecutive tokens
therefore share a chosen hash.

Defined results: null is the empty text, whose fingerprint is empty; texts with
fewer than k tokens have one k-gram of what there is, texts with tokens for
fewer hashes than a window have one window. Two empty fingerprints are alike
(1.0), an empty one and another are not (0.0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradespec.llm.common import KeyRanges, let, sortable, texts_of

K = 5
WINDOW = 8
#: Runs of letters and digits, 32 at most at a time, and single ideographs.
TOKEN = r"[\p{L}\p{N}\p{M}&&[^\x{2E80}-\x{9FFF}]]{1,32}|[\x{2E80}-\x{9FFF}]"
#: Hashes handled at once, and the low bits of a hash that hold its place among them.
_BLOCK = 4096
_PLACE_BITS = 13
_PLACES = (1 << _PLACE_BITS) - 1


def _block_minima(hashes: Column, k: int, window: int) -> Column:
    """Chosen entries of one block; an entry is a hash whose low bits hold its place.

    Places count down, so that of equal hashes the rightmost entry is smallest.
    """
    grams = F.greatest(F.size(hashes) - (k - 1), F.lit(1))
    # A hash of nulls skips them, so a text of fewer than k tokens has its own gram.
    entries = F.transform(
        F.sequence(F.lit(0), grams - 1),
        lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))
        .bitwiseAND(F.lit(~_PLACES))
        .bitwiseOR((F.lit(_PLACES - 1) - i).cast("long")),
    )

    def chosen(entries: Column) -> Column:
        windows = F.greatest(F.size(entries) - (window - 1), F.lit(1))
        return F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), windows - 1),
                lambda i: F.least(*(F.get(entries, i + j) for j in range(window))),
            )
        )

    return let(entries, chosen)


def _once(pairs: Column) -> Column:
    """Pairs in the order of positions, each once: blocks share their border."""
    return F.filter(
        pairs,
        lambda p, i: (i == 0) | (F.get(pairs, i - 1)["position"] != p["position"]),
    )


def winnowed(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """The chosen ``(hash, position)`` pairs of a text, in the order of positions."""
    if k + window + _BLOCK > _PLACES:
        raise ValueError(f"k + window must stay below {_PLACES - _BLOCK}")

    def tokens(found: Column) -> Column:
        marks = F.regexp_extract_all(text, F.lit(r"\S"), F.lit(0))
        return F.transform(
            F.when(F.size(found) > 0, found).otherwise(marks), lambda w: F.xxhash64(w)
        )

    words = let(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), tokens)

    def pairs(words: Column) -> Column:
        # Blocks overlap by what a window needs beyond its first hash.
        last_start = F.greatest(F.size(words) - (k + window - 2), F.lit(1)) - 1
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor(last_start / _BLOCK).cast("int")),
            lambda b: F.transform(
                let(
                    F.slice(words, b * _BLOCK + 1, _BLOCK + k + window - 2),
                    lambda block: _block_minima(block, k, window),
                ),
                lambda e: F.struct(
                    F.shiftright(e, _PLACE_BITS).alias("hash"),
                    (b * _BLOCK + _PLACES - 1 - e.bitwiseAND(F.lit(_PLACES)))
                    .cast("int")
                    .alias("position"),
                ),
            ),
        )
        return F.when(F.size(words) == 0, F.array().cast("array<struct<hash:bigint,position:int>>")).otherwise(
            let(F.flatten(blocks), _once)
        )

    return let(words, pairs)


def hashes_of(pairs: Column) -> Column:
    return F.array_distinct(F.transform(pairs, lambda p: p["hash"]))


def as_text(hashes: Column) -> Column:
    """A fingerprint as text: its hashes in hexadecimal, 13 digits each."""
    return F.array_join(
        F.transform(hashes, lambda h: F.lpad(F.hex(h.bitwiseAND(F.lit(2**51 - 1))), 13, "0")), ""
    )


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes."""
    shared = F.size(F.array_intersect(a, b))
    together = F.size(a) + F.size(b) - shared
    return F.when(together == 0, F.lit(1.0)).otherwise(shared / together)


def fingerprint(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id, hashes, positions`` for every row of ``docs``; no shuffle."""
    return (
        texts_of(docs)
        .select("doc_id", winnowed(F.col("text"), k, window).alias("pairs"))
        .select(
            "doc_id",
            F.transform("pairs", lambda p: p["hash"]).alias("hashes"),
            F.transform("pairs", lambda p: p["position"]).alias("positions"),
        )
    )


def fingerprint_against_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of texts and of texts whose second half is the next one's beginning.

    The next document is the one with the next larger ``doc_id``, after the last
    the first; rows without an id come first, rows of the same id are ordered by
    the digest of their text. Ranges of ids hold their rows in order, and the first
    row of each range is also dealt to the range before it, so texts move once.
    """
    rows = texts_of(docs)
    key = sortable(F.col("doc_id"))
    ranges = KeyRanges(rows, key)
    number = ranges.number(F.col("key"))
    dealt = (
        rows.withColumn("key", key)
        .withColumn("bucket", number)
        .withColumn(
            "to",
            F.when(
                ranges.starts(F.col("key"), F.col("bucket")),
                F.array(
                    F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lent")),
                    F.struct(
                        F.pmod(F.col("bucket") - 1, F.lit(ranges.count)).alias("bucket"),
                        F.lit(True).alias("lent"),
                    ),
                ),
            ).otherwise(
                F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("lent")))
            ),
        )
        .select("doc_id", "text", "key", F.explode("to").alias("to"))
        .select("doc_id", "text", "key", "to.bucket", "to.lent")
        .repartition("bucket")
        .withColumn("pairs", winnowed(F.col("text"), k, window))
        .withColumn("hashes", hashes_of(F.col("pairs")))
        .withColumn("tie", F.xxhash64("text"))
    )
    ordered = Window.partitionBy("bucket").orderBy("lent", "key", "tie", "text")
    half = (F.char_length("text") / 2).cast("int")
    paired = (
        dealt.withColumn("next_text", F.lead("text").over(ordered))
        .withColumn("next_hashes", F.lead("hashes").over(ordered))
        .filter(~F.col("lent"))
        .withColumn(
            "edited_text",
            F.concat(
                F.expr("substring(text, 1, char_length(text) - cast(char_length(text) / 2 as int))"),
                F.col("next_text").substr(F.lit(1), half),
            ),
        )
    )
    return paired.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        as_text(F.transform("pairs", lambda p: p["hash"])).alias("fingerprint"),
        F.transform("pairs", lambda p: p["position"]).alias("positions"),
        let(
            F.transform(winnowed(F.col("edited_text"), k, window), lambda p: p["hash"]),
            lambda e: F.struct(
                as_text(e).alias("text"),
                likeness(F.col("hashes"), F.array_distinct(e)).alias("near"),
            ),
        ).alias("edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    ).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        F.col("edited.text").alias("edited_fingerprint"),
        F.col("edited.near").alias("near_edited"),
        "near_next",
        "positions",
    )
