"""Similarity join on word n-grams by chosen paths.

Documents are sets of hashed n-grams. A run of the join sends every set down a
path: it is split on a sampled token, the one of the set that comes first in a
random order, which two sets share as often as their Jaccard similarity says.
Buckets that are small enough are compared by brute force, larger ones are split
again on further sampled tokens; runs are repeated until a pair at the threshold
is missed with less than the chance that the target recall leaves.

A large bucket of near copies does not get smaller by splitting. Before a split
its members are compared with one of them, the pivot, which connects all that
agree with it. A few strangers to it are compared with the whole bucket, and it is
done; only buckets with many are split. Members very close to the pivot leave with
their link to it: whatever is similar to them is close enough to the pivot to be
linked with it as well. Buckets still large after the last split are compared in
blocks, so no bucket is capped.

Buckets compare sketches and give candidate links with a margin. Documents that
hang together by candidates are then compared exactly, set by set, every pair
once, groups beyond one block in pairs of blocks over many tasks. Copies of a
text are one member that counts as often as it occurs.

Defined results: ``class_id`` is the smallest id of the documents that links
connect, ``n_links`` counts the other documents at or over the threshold, copies
included; several texts may share an id, each is in its own class then. Texts of fewer words than n have one n-gram, all their words; texts
without words are alike only where they are equal. Rows repeated with one id are
copies; a missing id counts as one of its own for each text.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradespec.llm.common import texts_of, written
from tradespec.llm.components import components
from tradespec.llm.wordhash import mixed, texts_word_hashes, windows

N = 5
THRESHOLD = 0.8
TARGET_RECALL = 0.9995
#: Values of a sketch; agreement that makes a candidate and that leaves with the pivot.
SKETCH = 64
CANDIDATE, CLOSE = 0.59, 0.94
#: Rows of a bucket or block compared at once, and splits of a run.
BLOCK = 256
SPLITS = 3
#: Members of a large bucket that are tried as its pivot, strangers to it that are
#: compared with the whole bucket, and rows of the bucket they meet at once.
PIVOTS, STRANGERS, ROWS = 6, 512, 2048
#: Runs before the members that are very close to a pivot leave for good.
AHEAD = 2
#: Rows of buckets, and texts to verify, that one task compares.
TASK_ROWS, TASK_TEXTS = 8192, 512
#: Members of candidate groups that may be broadcast (about 64 bytes each).
BROADCAST_ROWS = 500_000
_SEEDS = np.random.default_rng(7).integers(1, 2**63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold was split apart in all of them with
    a chance of ``1 - recall`` at most, be it in buckets that are split to the end."""
    if threshold >= 1:
        return 1
    stays = threshold * (1 - (1 - threshold) ** 2) ** SPLITS
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - stays)))


def shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of many texts in a row, and how many each has."""
    hashes, counts = texts_word_hashes([t.encode("utf-8", "replace") for t in texts])
    grams, starts = windows(hashes, counts, n)
    ends = np.cumsum(counts)
    owner = np.searchsorted(ends, starts, side="right")
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [
            mixed(np.array([h + np.uint64(k)], np.uint64))[0]
            for i in short
            for k, h in [(counts[i], _folded(hashes[ends[i] - counts[i] : ends[i]]))]
        ]
        owner = np.concatenate([owner, short])
        grams = np.concatenate([grams, np.array(whole, np.uint64)])
        order = np.argsort(owner, kind="stable")
        owner, grams = owner[order], grams[order]
    return grams, np.bincount(owner, minlength=len(texts))


def _folded(hashes: np.ndarray) -> np.uint64:
    total = np.zeros(1, np.uint64)
    for h in hashes:
        total = mixed(total + h)
    return total[0]


def _smallest(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest value of every text's n-grams in each random order; which have any."""
    grams, counts = shingles(texts, n)
    some = np.flatnonzero(counts)
    out = np.zeros((len(texts), SKETCH), np.uint64)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for j, seed in enumerate(_SEEDS):
            out[some, j] = np.minimum.reduceat(grams * seed, starts)
    return out, counts > 0


def sketches(docs: DataFrame, n: int, runs: int) -> DataFrame:
    """``doc_id, key, roots, sketch`` of every row; the key is the text's digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sizes = batch["text"].tolist(), np.cumsum(batch["text"].str.len().to_numpy())
            cuts = np.flatnonzero(np.diff(sizes // (1 << 20), prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(texts)]):
                least, some = _smallest(texts[a:b], n)
                short = (mixed(least) & np.uint64(0xFFFF)).astype("<u2")
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[a:b].to_numpy(),
                        "key": batch["key"].iloc[a:b].to_numpy(),
                        "roots": [r[:runs].view(np.int64) if s else None for r, s in zip(least, some)],
                        "sketch": [r.tobytes() if s else None for r, s in zip(short, some)],
                    }
                )

    # Ids go through as text: pandas would make doubles of longs beside a missing one.
    found = (
        texts_of(docs)
        .select(F.col("doc_id").cast("string").alias("doc_id"), "text", _digest("text").alias("key"))
        .mapInPandas(run, "doc_id string, key binary, roots array<long>, sketch binary")
    )
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _dealt(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """Written rows by their keys, in as many tasks as their number asks for: what Python
    does with them costs time that their bytes do not tell."""
    return rows.repartition(max(1, -(-rows.count() // each)), *keys)


def _forest(ids: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what a matrix of links joins: each member with its smallest."""
    names = np.arange(len(ids))
    while True:
        heard = np.where(linked, names[None, :], len(ids)).min(axis=1, initial=len(ids))
        better = np.minimum(names, heard)
        better = better[better]
        if (better == names).all():
            break
        names = better
    apart = np.flatnonzero(names != np.arange(len(ids)))
    return ids[apart], ids[names[apart]]


def _compare_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates("v").sort_values("v")
    ids = rows["v"].to_numpy(np.int64)
    values = np.frombuffer(b"".join(rows["sketch"]), "<u2").reshape(len(ids), SKETCH)
    linked = np.zeros((len(ids), len(ids)), bool)
    for i in range(len(ids)):
        linked[i] = (values == values[i]).sum(axis=1) >= CANDIDATE * SKETCH
    np.fill_diagonal(linked, False)
    a, b = _forest(ids, linked)
    return pd.DataFrame({"a": a, "b": b})


def _sketches(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2").reshape(-1, SKETCH)


def _agreement(one: pd.Series, several: pd.Series) -> pd.Series:
    """How far a sketch agrees with each of several packed ones."""
    return pd.Series(
        [(_sketches(b) == _sketches(a)).mean(axis=1).tolist() for a, b in zip(one, several)]
    )


def _against_pivot(large: DataFrame) -> DataFrame:
    """``path, v, sketch, pivot, alike, strangers``: large buckets against one member each.

    Of a few members, in random orders of them, the pivot is the one that most others
    agree with; strangers are how many do not.
    """
    agreement = F.pandas_udf(_agreement, "array<double>")
    tried = large.groupBy("path").agg(
        *[
            F.min_by(F.struct("v", "sketch"), F.xxhash64(F.lit(k), "v")).alias(f"p{k}")
            for k in range(PIVOTS)
        ]
    )
    tried = tried.select(
        "path",
        F.array(*[F.col(f"p{k}.v") for k in range(PIVOTS)]).alias("pivots"),
        F.concat(*[F.col(f"p{k}.sketch") for k in range(PIVOTS)]).alias("of_pivots"),
    )
    compared = written(
        large.join(tried, "path").select(
            "path", "size", "v", "sketch", "pivots",
                agreement("sketch", "of_pivots").alias("agreed"),
        ),
        "agreed",
    )
    alike = [
        F.count_if(F.get("agreed", F.lit(k)) >= CANDIDATE).alias(f"n{k}") for k in range(PIVOTS)
    ]
    best = compared.groupBy("path").agg(F.count(F.lit(1)).alias("all"), *alike)
    counts = F.array(*[F.col(f"n{k}") for k in range(PIVOTS)])
    best = best.select(
        "path",
        (F.array_position(counts, F.array_max(counts)) - 1).cast("int").alias("at"),
        (F.col("all") - F.array_max(counts)).alias("strangers"),
    )
    return compared.join(best, "path").select(
        "path",
        "size",
        "v",
        "sketch",
        F.get("pivots", "at").alias("pivot"),
        F.get("agreed", "at").alias("alike"),
        "strangers",
    )


def _few_strangers(judged: DataFrame) -> DataFrame:
    """Links of a bucket's few strangers, each compared with all of its bucket, in blocks:
    to each other, and to one of each block that the pivot has connected."""
    parts = F.ceil(F.col("size") / ROWS).cast("int")
    keys = ["path", "part"]
    strange = F.col("alike") < CANDIDATE
    asked = judged.select("path", F.pmod(F.xxhash64("v"), parts).cast("int").alias("part"), "v", "sketch", strange.alias("strange"))
    asking = judged.filter(strange).select(
        F.col("path").alias("path"),
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
        F.col("v").alias("s"),
        F.col("sketch").alias("of_s"),
    )

    def compare(members: pd.DataFrame, strangers: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(members) and len(strangers):
            members = members.sort_values("v")
            values, ids = _sketches(b"".join(members["sketch"])), members["v"].to_numpy(np.int64)
            mine = members["strange"].to_numpy(bool)
            for s, sketch in zip(strangers["s"], strangers["of_s"]):
                alike = (values == _sketches(sketch)).mean(axis=1) >= CANDIDATE
                found += [(v, s) for v in ids[alike & mine] if v != s]
                found += [(v, s) for v in ids[alike & ~mine][:1]]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return (
        asked.groupBy(*keys)
        .cogroup(asking.groupBy(*keys))
        .applyInPandas(compare, "a long, b long")
    )


def _sized(paths: DataFrame) -> DataFrame:
    """Paths with the size of their bucket, those alone in it left out."""
    sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return paths.join(sizes, "path")


def candidates(members: DataFrame, runs: int) -> DataFrame:
    """``a, b``: links between members whose sketches agree, enough to connect all such.

    The first runs go ahead: members that leave there, very close to a pivot that
    stays, take no part in the others.
    """
    left = members.filter("sketch is not null").select("v", "roots", "sketch")
    ahead = min(AHEAD, runs)
    links, gone = _run(left, range(ahead))
    if ahead < runs:
        left = written(left.join(gone, "v", "left_anti"), "members")
        links = links.unionByName(_run(left, range(ahead, runs))[0])
    return links.distinct()


def _together(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def _run(members: DataFrame, runs: range) -> tuple[DataFrame, DataFrame]:
    """Links of some runs, and the members that no further run needs.

    Splits only write their buckets. Afterwards the buckets of all splits are compared
    together and each kind of link is written by a query of its own: the plan of all of
    them at once is large and is made anew, on the driver, whenever a part of it ends.
    """
    sketch_of = members.select("v", "sketch")
    some = F.slice("roots", F.lit(runs.start + 1), F.lit(len(runs)))
    roots = members.select("v", F.posexplode(some).alias("run", "root")).select(
        "v", F.xxhash64(F.col("run") + F.lit(runs.start), "root").alias("path")
    )
    level = written(_sized(roots).join(sketch_of, "v"), "paths")
    levels, pivots, unsplit = [level], [], []
    for split in range(SPLITS + 1):
        large = level.filter(F.col("size") > BLOCK)
        if large.isEmpty():
            break
        judged = written(_against_pivot(large), "pivots")
        pivots.append(judged)
        # The pivot has connected all but the strangers. A few of them are compared with
        # the whole bucket, which settles it; of more the bucket is split.
        rest = judged.filter((F.col("strangers") > STRANGERS) & (F.col("alike") < CLOSE))
        if split == SPLITS:
            unsplit.append(rest)
            break
        chosen = F.pmod(F.xxhash64("path", F.col("turn")), F.lit(SKETCH)).cast("int")
        children = (
            rest.select("v", "sketch", "path", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
            .withColumn("at", chosen)
            .select(
                "v",
                "sketch",
                F.xxhash64("path", "at", F.expr("substring(sketch, 2 * at + 1, 2)")).alias("path"),
            )
        )
        level = written(_sized(children), "paths")
        levels.append(level)
    small = _together([x.select("path", "size", "v", "sketch") for x in levels]).filter(
        F.col("size") <= BLOCK
    )
    found = [
        _dealt(small, TASK_ROWS, "path")
        .groupBy("path")
        .applyInPandas(_compare_bucket, "a long, b long")
    ]
    gone = members.select("v").limit(0)
    if pivots:
        judged = _together(pivots)
        alike = F.col("alike") >= CANDIDATE
        found.append(
            judged.filter(alike & (F.col("v") != F.col("pivot"))).select(
                F.col("v").alias("a"), F.col("pivot").alias("b")
            )
        )
        found.append(_few_strangers(judged.filter(f"strangers BETWEEN 1 AND {STRANGERS}")))
        # Who leaves has a smaller one very close, so the smallest of such always stays.
        close = (F.col("alike") >= CLOSE) & (F.col("v") > F.col("pivot"))
        gone = judged.filter(close).select("v").distinct()
    found += [_in_blocks(rest) for rest in unsplit]
    return _together([written(links, "links") for links in found]), gone


def _in_blocks(rest: DataFrame) -> DataFrame:
    """Brute force over buckets of any size: every pair of blocks of a bucket is a task's."""
    sizes = rest.groupBy("path").agg(F.count(F.lit(1)).alias("left"))
    blocks = F.ceil(F.col("left") / BLOCK).cast("int")
    return (
        rest.join(sizes, "path")
        .withColumn("own", F.pmod(F.xxhash64("v"), blocks))
        .select("path", "v", "sketch", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        .select(
            "path", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "v", "sketch"
        )
        .groupBy("path", "i", "j")
        .applyInPandas(_compare_bucket, "a long, b long")
    )


def _shared(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """How many n-grams each two sets share; sets are distinct hashes in a row."""
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = grams[1:] != grams[:-1]
    number = np.cumsum(new) - 1
    often = np.bincount(number, minlength=1)[number] > 1
    _, column = np.unique(number[often], return_inverse=True)
    owner = owner[often]
    shared = np.zeros((len(counts), len(counts)), np.float32)
    width = max(1, (1 << 22) // max(1, len(counts)))
    edges = np.searchsorted(column, np.arange(0, column.max(initial=-1) + width + 1, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        part = np.zeros((len(counts), width), np.float32)
        part[owner[a:b], column[a:b] - k * width] = 1
        shared += part @ part.T
    return shared


def _verify(rows: pd.DataFrame, n: int, threshold: float) -> pd.DataFrame:
    """Exact links of a block, or between two blocks: per member how many, and a forest."""
    rows = rows.drop_duplicates("v").sort_values("v")
    ids, own = rows["v"].to_numpy(np.int64), rows["own"].to_numpy()
    grams, counts = shingles(rows["text"].tolist(), n)
    owner = np.repeat(np.arange(len(ids), dtype=np.int64), counts)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, counts = grams[new], np.bincount(owner[new], minlength=len(ids))
    shared = _shared(grams, counts)
    together = counts[:, None] + counts[None, :] - shared
    linked = (shared >= threshold * together) & (together > 0)
    np.fill_diagonal(linked, False)
    if rows["i"].iat[0] != rows["j"].iat[0]:
        linked &= own[:, None] != own[None, :]
    weights = rows["copies"].to_numpy(np.int64)
    a, b = _forest(ids, linked)
    names = dict(zip(a.tolist(), b.tolist()))
    return pd.DataFrame(
        {"v": ids, "links": linked @ weights, "name": [names.get(v, v) for v in ids.tolist()]}
    )


def linked_classes(
    docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = TARGET_RECALL
) -> DataFrame:
    """``doc_id, class_id, n_links`` of every row of ``docs``."""
    runs = min(SKETCH, runs_for(threshold, recall))
    rows = written(sketches(docs, n, runs), "sketches")
    # A member is a text: it is numbered once, and ids come back at the end. Several
    # texts may share an id, and all rows of a text may lack one.
    members = written(
        rows.groupBy("key")
        .agg(
            F.coalesce(F.min("doc_id"), F.xxhash64(F.lower(F.hex("key")))).alias("own"),
            F.count(F.lit(1)).alias("copies"),
            # Equal texts have equal ones.
            F.first("roots").alias("roots"),
            F.first("sketch").alias("sketch"),
        )
        .withColumn("v", F.monotonically_increasing_id()),
        "members",
    )
    groups = components(candidates(members, runs)).withColumnRenamed("component", "grp")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    grouped = written(
        groups.join(sizes, "grp").join(members.select("v", "key", "copies"), "v"), "groups"
    )
    texts = texts_of(docs).select("text", _digest("text").alias("key"))
    if grouped.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(grouped), "key")
    else:
        texts = texts.join(grouped, "key")
    # One row of each text, copies reduced in the tasks that read them.
    texts = written(
        texts.groupBy("v", "grp", "copies", "size").agg(F.first("text").alias("text")), "texts"
    )
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        return _verify(rows, n, threshold)

    verified = written(
        texts.withColumn("own", F.pmod(F.xxhash64("v"), blocks))
        .select(
            "grp", "v", "copies", "text", "own",
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
        )
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("other")
        .repartition(max(1, -(-texts.count() // TASK_TEXTS)), "grp", "i", "j")
        .groupBy("grp", "i", "j")
        .applyInPandas(verify, "v long, links long, name long"),
        "verified",
    )
    links = verified.groupBy("v").agg(F.sum("links").alias("links"))
    classes = components(verified.filter("v <> name").select(F.col("v").alias("a"), F.col("name").alias("b")))
    named = classes.join(members.select("v", "own"), "v")
    smallest = named.groupBy("component").agg(F.min("own").alias("class_id"))
    of_class = named.join(smallest, "component").select("v", "class_id")
    known = (
        members.select("key", "v", "own", "copies")
        .join(links, "v", "left")
        .join(of_class, "v", "left")
        .select(
            "key",
            F.coalesce("class_id", "own").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return rows.select("doc_id", "key").join(known, "key").select("doc_id", "class_id", "n_links")
