"""Cross-tokenizer alignment, counted over a minimal perfect hash of distinct pairs.

A text is encoded by tokenizer A (byte-level BPE, after a space) and by tokenizer B
(pieces, which add the space themselves). Byte offsets where tokens of both end cut the
tokens into groups; a link is a pair of an A and a B token whose bytes end together.

Texts are encoded once and their ids written; two passes go over those. The first aligns
them and leaves, for every batch of a task, its distinct pairs with their counts. The distinct pairs of the corpus are split into
segments by a hash; each segment gets a minimal perfect hash, and the counts of its
pairs are added up as dense vectors indexed by that hash: first a vector for
every branch of batches, then those vectors among each other, as a tree. A pair
found at a number is verified against the key kept there. The second pass aligns
the ids again and looks the counts up.

The table of counts is handed to all tasks if it has :data:`BROADCAST_PAIRS` pairs at
most; a larger one is joined with the pairs of the texts instead. The highest count of
each B id has one row for a B id, so its size is bounded by the vocabulary.

Defined results: a null or empty text, or one whose tokens do not spell a space and the
text (B may normalize), has no tokens: zeros, and '' for ``groups_sha256``. Repeated
rows, also with one id, and rows without an id are rows of their own that count each.
A text of any length is encoded whole. Special tokens in texts are plain text. Other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec.llm.common import texts_of, written
from tradespec.llm.perfect_hash import PerfectHash
from tradespec.llm.words import byte_characters

#: Pairs whose counts are handed to every task (17 bytes each), else they are joined.
BROADCAST_PAIRS = 1_000_000
#: Distinct pairs that a task holds before it hands them on.
HELD_PAIRS = 1 << 19
#: Distinct pairs of a segment, rows that one vector of it counts, vectors added up at once.
SEGMENT_PAIRS, BRANCH_ROWS, FAN_IN = 1 << 15, 1 << 20, 16
#: Characters of texts encoded at once.
CHUNK = 1 << 21
#: Texts aligned before their counts are added up.
ROWS = 512
#: Fixed value: how the byte-level tokenizer cuts texts before it merges.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPACE = "▁"


class Aligner:
    """Both tokenizers with the bytes that each of their ids stands for."""

    def __init__(self, byte_level: str, pieces: str):
        with open(byte_level, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"] for t in spec["added_tokens"]}
        back = {c: b for b, c in byte_characters().items()}
        spelled = {
            bytes(back[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in special
        }
        _ranked_by_id(spec["model"], back, spelled)
        self.a = tiktoken.Encoding(
            "byte_level", pat_str=_CUTS, mergeable_ranks=spelled, special_tokens={}
        )
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        tokens = {i: token for token, i in spelled.items()}
        self.a_bytes = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.ids = "<u2" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "<u4"
        self.a_lengths, self.b_lengths = (
            np.array([len(t) for t in table]) for table in (self.a_bytes, self.b_bytes)
        )
        self.a_names, self.b_names = (
            np.array([[f"{i}{end}" for i in range(len(table))] for end in ends], object)
            for table, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;"))
        )

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:-1], 16)])
        return self.b.id_to_piece(i).replace(_SPACE, " ").encode()

    def encoded(self, texts: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of A and B for every text; none if they do not spell it."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a, spelled = self.a.encode_ordinary(" " + text) if text else [], b" " + text.encode()
            if (
                b"".join([self.a_bytes[i] for i in a]) == spelled
                and b"".join([self.b_bytes[i] for i in b]) == spelled
            ):
                yield a, b
            else:
                yield [], []


class Alignment:
    """The tokens of one text; ``a_last`` and ``b_last`` are their places that end together."""

    def __init__(self, by: Aligner, a: bytes, b: bytes):
        self.by, self.a, self.b = by, np.frombuffer(a, by.ids), np.frombuffer(b, by.ids)
        a_ends, b_ends = by.a_lengths[self.a].cumsum(), by.b_lengths[self.b].cumsum()
        # No token is empty, so at most one token of a tokenizer ends at an offset.
        place = np.full(int(a_ends[-1]) + 1 if len(a_ends) else 1, -1, np.int32)
        place[a_ends] = np.arange(len(a_ends), dtype=np.int32)
        met = place[b_ends]
        self.b_last = np.flatnonzero(met >= 0)
        self.a_last = met[self.b_last]

    def pairs(self) -> np.ndarray:
        """The A and B id of every link as one number."""
        a, b = self.a[self.a_last].astype(np.uint64), self.b[self.b_last].astype(np.uint64)
        return a << np.uint64(32) | b

    def groups_digest(self) -> str:
        n_a, n_b = len(self.a), len(self.b)
        if not n_a:
            return ""
        a_ends, b_ends = np.zeros(n_a, np.int8), np.zeros(n_b, np.int8)
        a_ends[self.a_last] = b_ends[self.b_last] = 1
        a_sizes = np.diff(self.a_last, prepend=-1)
        b_sizes = np.diff(self.b_last, prepend=-1)
        # A's tokens stand after the B tokens of earlier groups, B's after the A tokens
        # of their own group too.
        names = np.empty(n_a + n_b, object)
        a_at = np.arange(n_a) + np.repeat(self.b_last + 1 - b_sizes, a_sizes)
        b_at = np.arange(n_b) + np.repeat(self.a_last + 1, b_sizes)
        names[a_at] = self.by.a_names[a_ends, self.a]
        names[b_at] = self.by.b_names[b_ends, self.b]
        return hashlib.sha256("".join(names.tolist())[:-1].encode()).hexdigest()


def _ranked_by_id(model: dict, back: dict[str, int], spelled: dict[bytes, int]) -> None:
    """Merges are looked up by the id of their result: that must be the order of merging."""
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [spelled[bytes(back[c] for c in left + right)] for left, right in merges]
    if ids != sorted(set(ids)):
        raise ValueError("the ids of merged tokens are not in the order of merging")


@functools.lru_cache(maxsize=2)
def aligner(byte_level: str, pieces: str) -> Aligner:
    """The tokenizers of two files, read once in a Python worker."""
    return Aligner(byte_level, pieces)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about :data:`CHUNK` characters."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, files: tuple[str, str]) -> DataFrame:
    """``doc_id, a, b``: the ids of both tokenizers for every row, as arrays of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = aligner(*files)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in _chunks(texts):
                both = zip(*by.encoded(texts[start:end]))
                a, b = ([np.array(x, by.ids).tobytes() for x in side] for side in both)
                ids = batch.column("doc_id").slice(start, end - start)
                yield pa.record_batch(
                    [ids, pa.array(a, pa.binary()), pa.array(b, pa.binary())],
                    names=["doc_id", "a", "b"],
                )

    return texts_of(docs).mapInArrow(run, "doc_id long, a binary, b binary")


def _aligned(by: Aligner, batch: pa.RecordBatch) -> Iterator[Alignment]:
    for a, b in zip(batch.column("a"), batch.column("b")):
        yield Alignment(by, a.as_py(), b.as_py())


def pair_counts(tokens: DataFrame, files: tuple[str, str]) -> DataFrame:
    """``batch, pair, links``: the distinct pairs of some texts of a task and how often they
    are linked in those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, task = aligner(*files), TaskContext.get().partitionId()
        pairs, links, number = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

        def held() -> pa.RecordBatch:
            columns = [np.full(len(pairs), task << 24 | number), pairs.view(np.int64), links]
            return pa.record_batch([pa.array(c) for c in columns], names=["batch", "pair", "links"])

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                found = np.concatenate([t.pairs() for t in _aligned(by, some)])
                found, often = np.unique(found, return_counts=True)
                both, place = np.unique(np.concatenate([pairs, found]), return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, place, np.concatenate([links, often]))
                pairs, links = both, total
                if len(pairs) >= HELD_PAIRS:
                    yield held()
                    pairs, links, number = pairs[:0], links[:0], number + 1
        yield held()

    return tokens.select("a", "b").mapInArrow(run, "batch long, pair long, links long")


def _keys(table: pa.Table) -> np.ndarray:
    return table["pair"].to_numpy().view(np.uint64)


def corpus_counts(counted: DataFrame) -> DataFrame:
    """``segment, pairs, links``: per segment its pairs in the order of their perfect hash,
    and beside them the dense vector of their counts over the corpus."""
    distinct = written(counted.select("pair").distinct(), "pairs")
    segments = max(1, -(-distinct.count() // SEGMENT_PAIRS))
    segment = F.pmod(F.xxhash64("pair"), F.lit(segments)).cast("int").alias("segment")

    def number(rows: pa.Table) -> pa.Table:
        keys = PerfectHash(_keys(rows)).keys.tobytes()
        return pa.table({"segment": rows["segment"].slice(0, 1), "pairs": pa.array([keys])})

    hashes = written(
        distinct.select(segment, "pair")
        .groupBy("segment")
        .applyInArrow(number, "segment int, pairs binary"),
        "hashes",
    )

    def counts(key: tuple, hashed: pa.Table, rows: pa.Table) -> pa.Table:
        index = PerfectHash(np.frombuffer(hashed["pairs"][0].as_py(), np.uint64))
        at = index.numbers(_keys(rows))
        if (at < 0).any():
            raise ValueError("a pair is missing from the hash of its segment")
        vector = np.zeros(len(index), np.int64)
        np.add.at(vector, at, rows["links"].to_numpy())
        return _vector(key, vector)

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), np.int64) for v in rows["links"])
        return _vector(key, total)

    # A branch adds up the counts of some batches; as many branches as their rows fill.
    branches = max(1, -(-counted.count() // (segments * BRANCH_ROWS)))
    branch = F.pmod(F.xxhash64("batch"), F.lit(branches)).cast("int").alias("branch")
    every = F.explode(F.sequence(F.lit(0), F.lit(branches - 1))).alias("branch")
    vectors = (
        hashes.select("segment", every, "pairs")
        .groupBy("segment", "branch")
        .cogroup(counted.select(segment, branch, "pair", "links").groupBy("segment", "branch"))
        .applyInArrow(counts, _VECTOR)
    )
    while branches > 1:
        branches = -(-branches // FAN_IN)
        vectors = (
            vectors.select("segment", F.pmod("branch", F.lit(branches)).alias("branch"), "links")
            .groupBy("segment", "branch")
            .applyInArrow(summed, _VECTOR)
        )
    return written(hashes.join(vectors.drop("branch"), "segment"), "counts")


_VECTOR = "segment int, branch int, links binary"


def _vector(key: tuple, vector: np.ndarray) -> pa.Table:
    return pa.table(
        {
            "segment": pa.array([key[0].as_py()], pa.int32()),
            "branch": pa.array([key[1].as_py()], pa.int32()),
            "links": pa.array([vector.astype(np.int64).tobytes()], pa.binary()),
        }
    )


def best_counts(counts: DataFrame) -> DataFrame:
    """``b, best``: the highest count of a pair with each B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, links in zip(batch.column("pairs"), batch.column("links")):
                b = np.frombuffer(pairs.as_py(), np.uint64) & np.uint64(0xFFFFFFFF)
                ids, place = np.unique(b, return_inverse=True)
                best = np.zeros(len(ids), np.int64)
                np.maximum.at(best, place, np.frombuffer(links.as_py(), np.int64))
                yield pa.record_batch(
                    [pa.array(ids.astype(np.int64)), pa.array(best)], names=["b", "best"]
                )

    found = counts.select("pairs", "links").mapInArrow(run, "b long, best long")
    return found.groupBy("b").agg(F.max("best").alias("best"))


def _pair_rows(counts: DataFrame) -> DataFrame:
    """``pair, links`` of a table of segments, one row per pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, links in zip(batch.column("pairs"), batch.column("links")):
                columns = [np.frombuffer(x.as_py(), np.int64) for x in (pairs, links)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["pair", "links"])

    return counts.select("pairs", "links").mapInArrow(run, "pair long, links long")


class Counts:
    """The counts of all pairs and whether each is its B id's highest, by perfect hash."""

    def __init__(self, pairs: bytes, links: bytes, best: dict[int, int]):
        given = np.frombuffer(pairs, np.uint64)
        self.index = PerfectHash(given)
        at = self.index.numbers(given)
        self.links = np.zeros(len(given), np.int64)
        self.links[at] = np.frombuffer(links, np.int64)
        b = (self.index.keys & np.uint64(0xFFFFFFFF)).tolist()
        self.best = self.links == np.array([best[i] for i in b], np.int64)

    def of(self, pairs: np.ndarray) -> tuple[int, int]:
        """How many links have a highest count, and the sum of all their counts."""
        at = self.index.numbers(pairs)
        if (at < 0).any():
            raise ValueError("a pair was not counted")
        return int(self.best[at].sum()), int(self.links[at].sum())


_HEAD = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_COLUMNS = (
    "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256",
)


def _realigned(tokens: DataFrame, files: tuple[str, str], more: str, judged) -> DataFrame:
    """The tokens aligned once more, with what ``judged`` makes of a text's pairs."""
    schema = f"{_HEAD}, {more}"
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    fields = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, judge = aligner(*files), judged()
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                rows = []
                for t in _aligned(by, some):
                    links = len(t.a_last)
                    head = len(t.a), len(t.b), links, links, t.groups_digest()
                    rows.append((*head, *judge(t.pairs())))
                found = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(fields)[2:])]
                ids = [some.column("rid"), some.column("doc_id")]
                yield pa.record_batch([*ids, *found], schema=fields)

    return tokens.select("rid", "doc_id", "a", "b").mapInArrow(run, schema)


def align(
    docs: DataFrame, byte_level: str, pieces: str, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    spark, files = docs.sparkSession, (byte_level, pieces)
    tokens = written(encoded(docs, files), "tokens")
    counted = written(pair_counts(tokens, files), "pair_counts")
    counts = corpus_counts(counted)
    best = best_counts(counts)
    numbered = tokens.withColumn("rid", F.monotonically_increasing_id())
    size = counts.agg(F.sum(F.length("pairs"))).first()[0] or 0
    if size <= 8 * broadcast_pairs:
        rows = counts.select("pairs", "links").collect()
        table = spark.sparkContext.broadcast(
            (
                b"".join(bytes(r.pairs) for r in rows),
                b"".join(bytes(r.links) for r in rows),
                {r.b: r.best for r in best.collect()},
            )
        )

        def by_hash():
            return Counts(*table.value).of

        found = _realigned(numbered, files, "n_best long, count_sum long", by_hash)
        return found.select(*_COLUMNS)

    def as_pairs():
        def judge(pairs: np.ndarray) -> tuple[list, list]:
            ids, often = np.unique(pairs, return_counts=True)
            return ids.view(np.int64).tolist(), often.tolist()

        return judge

    aligned = written(
        _realigned(numbered, files, "pairs array<long>, times array<long>", as_pairs), "aligned"
    )
    asked = aligned.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(
        "rid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times")
    )
    known = (
        _pair_rows(counts)
        .withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
        .join(best, "b")
        .select("pair", "links", (F.col("links") == F.col("best")).alias("is_best"))
    )
    sums = (
        asked.join(known, "pair")
        .groupBy("rid")
        .agg(
            F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("links")).alias("count_sum"),
        )
    )
    return aligned.join(sums, "rid", "left").na.fill(0, ["n_best", "count_sum"]).select(*_COLUMNS)
