"""Removing passages that an earlier document has, by windows of words.

Documents are dealt to groups by a hash of their id. Each group sketches its
windows: one cell number of a wide count-min row per distinct window, sorted and
packed by ranges of cells. Merged by range, the sketches overestimate in how many
groups a window occurs, never the reverse, and each group gets back one bit per
cell: counted again elsewhere or not. Only windows with that bit set are then
grouped exactly, by two hashes of the word sequence, made of two independent hashes
of every word, and again each group gets
back one bit per distinct window: whether a smaller document id has it in another
group. Windows repeated within a group are settled there. A window that a third
of all documents share is thus sent once per group.

Defined results: null texts have no words; rows without an id come after all
others and remove nothing; rows of the same id, repeated ones included, do not remove
each other's words. Texts of any length are taken whole, as are words of any length.
Other columns of the table are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec.llm.common import texts_of
from tradespec.llm.wordhash import texts_word_pairs, windows

WINDOW = 13
#: Bytes of text in a group, groups whose sketches a range of cells is cut for,
#: and bits of a cell number within its range.
GROUP_BYTES = 6 << 20
CELL_BITS = 27
#: Stands for a missing id while ids are compared.
_NO_ID = 2**63 - 1


class _Group:
    """The windows of a group of documents."""

    def __init__(self, rows: pd.DataFrame, size: int, exact: bool):
        self.ids = rows["doc_id"].to_numpy(np.int64)
        self.order = np.argsort(self.ids, kind="stable")
        self.raw = [rows["text"].iat[i].encode("utf-8", "replace") for i in self.order]
        self.ids = self.ids[self.order]
        one, other, self.counts = texts_word_pairs(self.raw)
        self.first, self.starts = windows(one, self.counts, size)
        if exact:
            self.second, _ = windows(other, self.counts, size, seed=2)
        self.owner = np.repeat(np.arange(len(self.ids)), self.counts)[self.starts]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows: an index of each, its smallest id, the place of every window."""
        order = np.argsort(self.first, kind="stable")
        first, second = self.first[order], self.second[order]
        new = np.ones(len(order), bool)
        new[1:] = first[1:] != first[:-1]
        if (second[1:] != second[:-1])[~new[1:]].any():
            # Different windows with one first hash: sort by both.
            order = np.lexsort((self.second, self.first))
            first, second = self.first[order], self.second[order]
            new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        # Windows are in the order of ids, and the sorts keep it among equals.
        index = order[new]
        return index, self.ids[self.owner[index]], place


def _cells(hashes: np.ndarray, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Range and cell within the range of window hashes."""
    cells = hashes >> np.uint64(64 - CELL_BITS)
    of = (hashes & np.uint64(0xFFFFFFFF)) * np.uint64(ranges) >> np.uint64(32)
    return of.astype(np.int64), cells.astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    return zlib.compress(values.tobytes(), 1)


def _sketch(rows: pd.DataFrame, size: int, ranges: int) -> pd.DataFrame:
    group = _Group(rows, size, exact=False)
    of, cells = _cells(group.first, ranges)
    keys = np.unique((of << CELL_BITS) | cells)
    of, cells = keys >> CELL_BITS, keys & ((1 << CELL_BITS) - 1)
    edges = np.searchsorted(of, np.arange(ranges + 1))
    out = []
    for r in range(ranges):
        mine = cells[edges[r] : edges[r + 1]]
        if len(mine):
            # Differences of sorted cells; three bytes hold most, zlib packs the rest.
            out.append((r, _packed(np.diff(mine, prepend=0).astype("<u4").view("u1").reshape(-1, 4).T.copy())))
    return pd.DataFrame(
        {
            "g": np.full(len(out), rows["g"].iat[0], np.int64),
            "r": np.array([o[0] for o in out], np.int64),
            "cells": [o[1] for o in out],
        }
    )


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range of cells: for every group, which of its cells others count as well."""
    parts = []
    for packed in rows["cells"]:
        planes = np.frombuffer(zlib.decompress(packed), "u1").reshape(4, -1)
        parts.append(np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)))
    everything = np.sort(np.concatenate(parts))
    again = np.unique(everything[1:][everything[1:] == everything[:-1]])
    bits = []
    for cells in parts:
        at = np.minimum(np.searchsorted(again, cells), max(len(again) - 1, 0))
        hit = again[at] == cells if len(again) else np.zeros(len(cells), bool)
        bits.append(_packed(np.packbits(hit)))
    return pd.DataFrame({"g": rows["g"], "r": rows["r"], "bits": bits})


def _candidates(rows: pd.DataFrame, sketch: pd.DataFrame, size: int, ranges: int) -> pd.DataFrame:
    """Distinct windows of a group that are estimated to occur in others, for exact grouping."""
    columns = ["g", "r", "windows"]
    if not len(rows):
        return pd.DataFrame({c: [] for c in columns})
    group = _Group(rows, size, exact=True)
    index, least, _ = _estimated(group, sketch, ranges)
    of, _ = _cells(group.first[index], ranges)
    out = []
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(ranges + 1))
    for r in range(ranges):
        mine = order[edges[r] : edges[r + 1]]
        if len(mine):
            a, b = group.first[index[mine]], group.second[index[mine]]
            base = least[mine].min()
            out.append(
                (r, a.tobytes() + b.tobytes() + _ids_packed(least[mine] - base) + int(base).to_bytes(8, "little", signed=True))
            )
    return pd.DataFrame(
        {
            "g": np.full(len(out), rows["g"].iat[0], np.int64),
            "r": np.array([o[0] for o in out], np.int64),
            "windows": [o[1] for o in out],
        }
    )


def _ids_packed(values: np.ndarray) -> bytes:
    packed = _packed(values.astype("<u8").view("u1").reshape(-1, 8).T.copy())
    return packed + len(packed).to_bytes(4, "little")


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    base = int.from_bytes(blob[-8:], "little", signed=True)
    size = int.from_bytes(blob[-12:-8], "little")
    planes = np.frombuffer(zlib.decompress(blob[-12 - size : -12]), "u1").reshape(8, -1)
    ids = np.ascontiguousarray(planes.T).view("<u8").ravel()
    n = len(ids)
    pair = np.frombuffer(blob[: 16 * n], "<u8")
    return pair[:n], pair[n:], ids.astype(np.int64) + base


def _estimated(group: _Group, sketch: pd.DataFrame, ranges: int):
    """Distinct windows whose cells came back marked, in a fixed order."""
    index, least, place = group.distinct()
    of, cells = _cells(group.first[index], ranges)
    keys = (of << CELL_BITS) | cells
    sorted_keys, at = np.unique(keys, return_inverse=True)
    marks = np.zeros(len(sorted_keys), bool)
    edges = np.searchsorted(sorted_keys >> CELL_BITS, np.arange(ranges + 1))
    for r, bits in zip(sketch["r"], sketch["bits"]):
        a, b = edges[r], edges[r + 1]
        marks[a:b] = np.unpackbits(np.frombuffer(zlib.decompress(bits), "u1"), count=b - a)
    chosen = np.flatnonzero(marks[at])
    return index[chosen], least[chosen], (index, least, place, chosen)


def _least(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range: for every group, which of its windows have a smaller id elsewhere."""
    parts = [_unpacked(b) for b in rows["windows"]]
    sizes = [len(p[0]) for p in parts]
    a, b, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((ids, b, a))
    a, b, ids = a[order], b[order], ids[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    smallest = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
    beaten = np.empty(len(a), bool)
    beaten[order] = smallest < ids
    bits = [_packed(np.packbits(x)) for x in np.split(beaten, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"g": rows["g"], "r": rows["r"], "bits": bits})


def _kept(
    rows: pd.DataFrame, both: pd.DataFrame, size: int, ranges: int, with_text: bool
) -> pd.DataFrame:
    """What is left of the documents of a group."""
    columns = ["doc_id", "n_words", "n_removed", "kept"]
    if not len(rows):
        return pd.DataFrame({c: [] for c in columns})
    group = _Group(rows, size, exact=True)
    sketch = both[both["kind"] == 0]
    found, _, (index, least, place, chosen) = _estimated(group, sketch, ranges)
    of, _ = _cells(group.first[found], ranges)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(ranges + 1))
    verdicts = both[both["kind"] == 1]
    beaten = np.zeros(len(index), bool)
    for r, bits in zip(verdicts["r"], verdicts["bits"]):
        mine = order[edges[r] : edges[r + 1]]
        beaten[chosen[mine]] = np.unpackbits(
            np.frombuffer(zlib.decompress(bits), "u1"), count=len(mine)
        ).astype(bool)
    repeated = beaten[place] | (group.ids[group.owner] > least[place])
    cover = np.zeros(group.counts.sum() + 1, np.int64)
    # Starts are distinct, and so are the places after the windows.
    cover[group.starts[repeated]] += 1
    cover[group.starts[repeated] + size] -= 1
    removed = np.cumsum(cover)[:-1] > 0
    ends = np.cumsum(group.counts)
    out = []
    for i, raw in enumerate(group.raw):
        gone = removed[ends[i] - group.counts[i] : ends[i]]
        words = raw.split()
        if gone.any():
            words = [w for w, x in zip(words, gone) if not x]
        kept = b" ".join(words)
        out.append(kept.decode("utf-8") if with_text else hashlib.sha256(kept).hexdigest())
    lengths = group.counts.astype(np.int64)
    totals = np.concatenate([[0], np.cumsum(removed)])
    return pd.DataFrame(
        {
            "doc_id": group.ids,
            "n_words": lengths,
            "n_removed": totals[ends] - totals[ends - lengths],
            "kept": out,
        }
    )


def remove_repeated(docs: DataFrame, size: int = WINDOW, with_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` of every row.

    ``kept`` is the text left, its words joined by one blank, or that text's SHA-256
    in hexadecimal without ``with_text``.
    """
    rows = texts_of(docs)
    total = rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    # A range holds the windows of about four groups.
    ranges = max(1, groups // 4)
    dealt = rows.select(
        F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(groups)).alias("g"),
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"),
        "text",
    )
    by_group = dealt.groupBy("g")

    def sketch(rows: pd.DataFrame) -> pd.DataFrame:
        return _sketch(rows, size, ranges)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        return _merge(rows)

    def candidates(rows: pd.DataFrame, sketch: pd.DataFrame) -> pd.DataFrame:
        return _candidates(rows, sketch, size, ranges)

    def least(rows: pd.DataFrame) -> pd.DataFrame:
        return _least(rows)

    def kept(rows: pd.DataFrame, both: pd.DataFrame) -> pd.DataFrame:
        return _kept(rows, both, size, ranges, with_text)

    sketches = by_group.applyInPandas(sketch, "g long, r long, cells binary")
    marks = sketches.groupBy("r").applyInPandas(merge, "g long, r long, bits binary")
    estimated = by_group.cogroup(marks.groupBy("g")).applyInPandas(
        candidates, "g long, r long, windows binary"
    )
    verdicts = estimated.groupBy("r").applyInPandas(least, "g long, r long, bits binary")
    both = marks.withColumn("kind", F.lit(0)).unionByName(verdicts.withColumn("kind", F.lit(1)))
    left = by_group.cogroup(both.groupBy("g")).applyInPandas(
        kept, "doc_id long, n_words long, n_removed long, kept string"
    )
    return left.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID)))
