"""Packing documents into sequences by bin completion.

Documents become token pieces; only those longer than a sequence are cut. How
pieces share sequences depends on nothing but their lengths, of which there are
as many as a sequence has tokens, so the plan is made over the table of counts
by length. Starting from the best-fit-decreasing plan, a branch-and-bound search
fills sequences around the largest length left. It enumerates all maximal fillings
of what is left beside it, lazily and least waste first, leaves out those that the
Martello-Toth dominance test removes, and gives up branches whose lower bound is
not under the best plan so far. Each filling is tried for as many sequences as the
counts allow, then for fewer.

The search is complete: it ends with the fewest sequences, unless its steps end
before. A plan says which (``proven``) and gives the lower bound (``least``).
Pieces of a length are then numbered and take the places of the plan in that order.

Defined results: null text is an empty document, one piece holding the closing
id alone; repeated rows are packed as often as they come.
"""

from __future__ import annotations

import bisect
import functools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradespec.llm.common import texts_of, written
from tradespec.llm.words import WordCache, words_of

CAPACITY = 4096
END_ID = 1
#: Steps of the search; every filling looked at is one, dominated ones too.
SEARCH_STEPS = 20_000
#: Places of the search, counted from its end, whose enumerations stay in memory; others
#: are taken up again where they were left when the search comes back to them.
_LIVE = 8
#: Rows numbered together.
_RANK_ROWS = 50_000


class _Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        self.words = words_of(path)
        self.model = self.words.tokenizer.model
        self.word = WordCache(self._word)
        self.chunk = WordCache(self._chunk)

    def _word(self, word: str) -> bytes:
        if word in self.words.added:
            ids = [self.words.added[word]]
        else:
            ids = [t.id for t in self.model.tokenize(self.words.spelled(word))]
        return np.array(ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([self.word[w] for w in self.words.words_in(chunk)])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.chunk.__getitem__, self.words.chunks(text)))


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the token pieces of every row."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encoder.encode(text) + end
                for start in range(0, len(ids) // 4, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append(
                        (doc_id, start // capacity, start, len(part) // 4, zlib.crc32(part))
                    )
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
            yield out

    return texts_of(docs).mapInPandas(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


@dataclass
class Plan:
    """Fillings and how many sequences each is used for.

    ``least`` is a lower bound of the sequences; ``proven`` says that none has fewer.
    """

    fillings: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    least: int = 0
    proven: bool = False

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.fillings)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts: each length goes where it leaves least room."""
    open_: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                open_.setdefault(capacity - length, Counter())[(length,)] += left
                left = 0
                # Sequences opened at once take more of the same length.
                if capacity - length >= length:
                    fit = capacity // length
                    opened = open_[capacity - length].pop((length,))
                    if not open_[capacity - length]:
                        del open_[capacity - length]
                    full, rest = divmod(opened, fit)
                    for n, times in ((fit, full), (rest, 1)):
                        if n and times:
                            open_.setdefault(capacity - n * length, Counter())[
                                (length,) * n
                            ] += times
                continue
            filling, times = next(iter(open_[room].items()))
            more = min(room // length, max(1, left))
            used = min(times, left // more)
            open_[room][filling] -= used
            if not open_[room][filling]:
                del open_[room][filling]
            if not open_[room]:
                del open_[room]
            open_.setdefault(room - more * length, Counter())[filling + (length,) * more] += used
            left -= used * more
    return Plan([(f, n) for group in open_.values() for f, n in group.items()])


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's bound L2: pieces over half a sequence share none, and those
    too large to take any of the pieces from some length on leave their room unused."""
    number = np.zeros(capacity + 1, np.int64)
    number[list(counts)] = list(counts.values())
    tokens = number * np.arange(capacity + 1)
    upto, sums = np.cumsum(number), np.cumsum(tokens)
    half = capacity // 2
    least = np.arange(1, half + 1)
    over_half = upto[capacity] - upto[half]
    middle = upto[capacity - least] - upto[half]
    room = middle * capacity - (sums[capacity - least] - sums[half])
    rest = np.maximum(0, -(-(sums[half] - sums[least - 1] - room) // capacity))
    return int(max(over_half + rest.max(initial=0), -(-sums[capacity] // capacity)))


def _smeared(sums: int, by: int) -> int:
    """A set of sums, as bits, with every sum from each one to ``by`` more."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        sums |= sums << step
        done += step
    return sums


def _is_dominated(filling: tuple[int, ...], waste: int, others: int) -> bool:
    """Whether one piece left outside (``others``, lengths as bits) may take the place
    of some of the filling: it is as long as two or more of them together, or longer
    than what it replaces, and fits. The piece then leaves no more waste, and what it
    replaces fits where it would have been."""
    one = some = several = 0
    for length in filling:
        several |= some << length
        some |= (some << length) | (1 << length)
        one |= 1 << length
    if _smeared(several, waste) & others:
        return True
    return waste > 0 and bool(_smeared(one << 1, waste - 1) & others)


def _fillings(
    counts: dict[int, int], room: int, most_waste: Callable[[], int]
) -> Iterator[tuple[int, ...] | None]:
    """All maximal undominated ways to fill ``room``, least waste first, then the
    longest pieces first; None for each dominated one on the way.

    Stops beyond the waste ``most_waste()``.
    """
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    present = np.zeros(max(counts) + 1, np.uint8)
    present[[n for n, c in counts.items() if c]] = 1
    left = int.from_bytes(np.packbits(present, bitorder="little").tobytes(), "little")
    mask = (1 << (room + 1)) - 1
    top = len(lengths)
    reach: list[int] = []
    ascending = lengths[::-1]
    waste = 0
    while waste <= min(room, most_waste()):
        # Pieces that would fit into the waste are all taken, else it were not maximal.
        small = bisect.bisect_right(ascending, waste)
        forced = tuple(n for n in lengths[top - small :] for _ in range(counts[n]))
        spare = room - sum(forced)
        if spare < waste:
            return
        end = top - small
        if len(reach) != end + 1:
            # Sums that lengths from each place on can have, as bits.
            reach = [1]
            for n in reversed(lengths[:end]):
                sums, many, take = reach[-1], min(counts[n], room // n), 1
                while many:
                    take = min(take, many)
                    sums |= (sums << (n * take)) & mask
                    many -= take
                    take *= 2
                reach.append(sums)
            reach.reverse()
        # The largest sum that leaves this waste or more, as long as no further piece fits.
        wanted = (reach[0] & ((1 << (spare - waste + 1)) - 1)).bit_length() - 1
        if small < top and spare - wanted >= ascending[small]:
            waste = ascending[small]
            continue
        waste = spare - wanted
        if waste > most_waste():
            return

        def exact(at: int, sum_: int) -> Iterator[tuple[int, ...]]:
            if not sum_:
                yield ()
                return
            at = max(at, top - bisect.bisect_right(ascending, sum_))
            for i in range(at, end):
                if not reach[i] >> sum_ & 1:
                    return
                n = lengths[i]
                for many in range(min(counts[n], sum_ // n), 0, -1):
                    if reach[i + 1] >> (sum_ - many * n) & 1:
                        for more in exact(i + 1, sum_ - many * n):
                            yield (n,) * many + more

        for found in exact(0, wanted):
            filling = found + forced
            used = Counter(filling)
            others = left & ~sum(1 << n for n, c in used.items() if counts[n] == c)
            yield None if _is_dominated(filling, waste, others) else filling
        waste += 1


def complete(counts: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> Plan:
    """The best plan found within ``steps`` steps; never worse than best fit."""
    counts = {n: c for n, c in counts.items() if c > 0}
    best = best_fit(counts, capacity)
    fewest, least = best.sequences, lower_bound(counts, capacity)
    left = dict(counts)
    path: list[list] = []
    used = 0

    def branch(at: list[int]) -> Iterator[tuple[tuple[int, ...], int] | None]:
        """Fillings with their uses, from ``at`` on: uses left out, fillings seen."""
        fewer, seen = at
        largest = max(n for n, c in left.items() if c)
        rest, before = sum(n * c for n, c in left.items()), used
        # A filling on the path is used as often as it was decided there.
        decided = {step[0] for step in path if step[0][0] == largest}
        own = {n: c for n, c in left.items() if c}
        own[largest] -= 1

        def most_waste() -> int:
            return (fewest - 1 - before) * capacity - rest

        more = True
        while more:
            more = False
            for n, option in enumerate(_fillings(own, capacity - largest, most_waste), 1):
                found = None
                if option is not None and (largest, *option) not in decided:
                    filling = (largest, *option)
                    times = min(left[x] // c for x, c in Counter(filling).items()) - fewer
                    more |= times > 1
                    found = (filling, times) if times > 0 else None
                if n > seen:
                    at[:] = fewer, n
                    yield found
            fewer, seen = fewer + 1, 0

    proven = fewest <= least
    place = [0, 0]
    options = iter(()) if proven else branch(place)
    while not proven and steps > 0:
        steps -= 1
        step = next(options, False)
        if step is None:
            continue
        if step is False:
            if not path:
                proven = True
                break
            filling, times, place, options = path.pop()
            for n in filling:
                left[n] += times
            used -= times
            options = options or branch(place)
            continue
        filling, times = step
        for n in filling:
            left[n] -= times
        used += times
        path.append([filling, times, place, options])
        if len(path) > _LIVE:
            path[-_LIVE - 1][-1] = None
        bound = used + lower_bound(left, capacity)
        if used < fewest and not any(left.values()):
            best, fewest = Plan([(f, t) for f, t, _, _ in path]), used
            proven = fewest <= least
        place = [0, 0]
        options = branch(place) if bound < fewest else iter(())
    best.least, best.proven = (fewest if proven else least), proven
    return best


def _places(plan: Plan) -> pd.DataFrame:
    """Per length the ranges of numbers that take a place of the plan."""
    taken: Counter = Counter()
    rows, sequence = [], 0
    for filling, times in plan.fillings:
        offset = 0
        for length, many in sorted(Counter(filling).items(), reverse=True):
            # ``many`` numbers in a row share a sequence.
            rows.append((length, taken[length], many, times, sequence, offset))
            taken[length] += many * times
            offset += many * length
        sequence += times
    return pd.DataFrame(
        rows, columns=["length", "from_number", "many", "times", "sequence", "offset"]
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece."""
    spark = docs.sparkSession
    table = written(pieces(docs, path, capacity, end_id), "pieces")
    # As many rows as there are lengths, ``capacity`` at most.
    counts = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    plan = complete(counts, capacity)
    places = _places(plan).sort_values(["length", "from_number"])

    # Numbers within a length: by group of rows, then from where the group starts.
    groups = max(1, -(-sum(counts.values()) // _RANK_ROWS))
    grouped = table.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    before = (
        grouped.groupBy("length", "part")
        .count()
        .withColumn(
            "before",
            F.coalesce(
                F.sum("count").over(
                    Window.partitionBy("length")
                    .orderBy("part")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("count")
    )
    within = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        grouped.withColumn("own", F.row_number().over(within) - 1)
        .join(before, ["length", "part"])
        .withColumn("number", F.col("own") + F.col("before"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    )
    sent = spark.sparkContext.broadcast({c: places[c].to_numpy() for c in places.columns})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = sent.value
        # Both keys in one: numbers of a length stay below the next length's.
        wide = int((p["from_number"] + p["many"] * p["times"]).max()) + 1 if len(p["length"]) else 1
        keys = p["length"] * wide + p["from_number"]
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch.pop("number").to_numpy()
            at = np.searchsorted(keys, length * wide + number, side="right") - 1
            turn, seat = np.divmod(number - p["from_number"][at], p["many"][at])
            batch["sequence_id"] = p["sequence"][at] + turn
            batch["offset"] = p["offset"][at] + seat * length
            yield batch

    return numbered.mapInPandas(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long",
    )
