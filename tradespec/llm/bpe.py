"""BPE encoding and decoding with an automaton over tokens.

The automaton starts with one state that every base symbol leads back to. Merges
are compiled one after the other. The merge of u and v adds a gadget: the state
that u leads to is copied without its v arc, all u arcs are redirected to the
copy, and every state with a u arc gets an arc for the merged token to where v
leads. Paths of the finished automaton are exactly the encodings that applying
the merges in order gives, one for each text.

All arcs of a token lead to one state, so the tables hold for each token its parts
and the merge that made it, for each state the arcs it lost. A word is encoded by following, for each of its ends, the one arc that leads there;
decoding emits the labels of the arcs.

Defined results: null and empty texts have no tokens; added tokens in a text are
themselves, as the library has it.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tradespec.llm.common import texts_of
from tradespec.llm.words import WORD_END, WordCache, Words, words_of


class TokenAutomaton:
    """Tables of the automaton. The state that a token leads to has the token's number.

    ``lost`` has the merge at which a state's copy lost an arc. The copy for u came
    from where u led before: the state of its right part, as it was when u was
    made. So the arcs that a state lost are found along the right parts of its
    token, and a merged token's arc exists where its left part's did.
    """

    START = -1

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.ids = vocabulary
        self.label = {i: t for t, i in vocabulary.items()}
        self._width = max(self.label, default=0) + 1
        self._never = len(merges)
        # Of a token: the merge that made it (-1: none) and its two parts.
        self.born = dict.fromkeys(self.label, -1)
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.lost: dict[int, int] = {}
        self._known: dict[int, bool] = {}
        made = {u + v for u, v in merges}
        self.usable = {t: t not in made for t in vocabulary}
        for number, (u, v) in enumerate(merges):
            self._add_gadget(number, u, v)
        # Every ending of a token, with the token's id where it is one itself.
        self.endings: dict[str, int] = {}
        for label, token in vocabulary.items():
            if self.usable[label]:
                body = label.removesuffix(WORD_END)
                for start in range(1, len(body)):
                    self.endings.setdefault(label[start:], -1)
                self.endings[label] = token

    def _add_gadget(self, number: int, u: str, v: str) -> None:
        left, right, both = self.ids[u], self.ids[v], self.ids[u + v]
        if self.usable[u] and self.usable[v] and self._has_arc(left, right):
            self.usable[u + v] = True
            self.lost[left * self._width + right] = number
            self.born[both], self.left[both], self.right[both] = number, left, right

    def _has_arc(self, state: int, token: int) -> bool:
        now = self._never
        while True:
            born, part, until = self.born[token], state, now
            while until > born:
                if self.lost.get(part * self._width + token, self._never) < until:
                    return False
                until = min(until, self.born[part])
                part = self.right.get(part, part)
            if born < 0:
                return True
            now, token = born + 1, self.left[token]

    def has_arc(self, state: int, token: int) -> bool:
        """Whether a state has an arc for a token; looked up once while it is remembered."""
        if state == self.START:
            return True
        if len(self._known) > 500_000:
            self._known.clear()
        known = self._known[state * self._width + token] = self._has_arc(state, token)
        return known

    def encode(self, symbols: str) -> list[int]:
        """Token ids of a word given in byte characters, its end not marked."""
        size, ending, known, width = len(symbols), self.endings.get, self._known, self._width
        states, starts = [self.START] * (size + 1), [0] * (size + 1)
        for end in range(1, size + 1):
            text, stop = (symbols, end) if end < size else (symbols + WORD_END, None)
            for start in range(end - 1, -1, -1):
                token = ending(text[start:stop])
                if token is None:
                    raise ValueError(f"no path for {symbols!r}")
                if token >= 0:
                    state = states[start]
                    arc = state < 0 or known.get(state * width + token)
                    if arc is None:
                        arc = self.has_arc(state, token)
                    if arc:
                        states[end], starts[end] = token, start
                        break
            else:
                raise ValueError(f"no path for {symbols!r}")
        found = []
        while size:
            found.append(states[size])
            size = starts[size]
        return found[::-1]


class Coder:
    """Encodes texts by words; a word is encoded once while a cache holds it."""

    def __init__(self, words: Words):
        self.words = words
        model = words.spec["model"]
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        added = set(words.added)
        self.automaton = TokenAutomaton(
            {t: i for t, i in model["vocab"].items() if t not in added}, merges
        )
        self.label = self.automaton.label | {i: t for t, i in words.added.items()}
        self.word = WordCache(self._word)
        self.chunk = WordCache(self._chunk)

    def _word(self, word: str) -> tuple[int, str, str]:
        if word in self.words.added:
            ids = [self.words.added[word]]
        else:
            ids = self.automaton.encode(self.words.spelled(word))
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.label.__getitem__, ids))

    def _chunk(self, chunk: str) -> tuple[int, str, str]:
        found = [self.word[w] for w in self.words.words_in(chunk)]
        if len(found) == 1:
            return found[0]
        return sum(f[0] for f in found), " ".join(f[1] for f in found), " ".join(f[2] for f in found)

    def ids(self, text: str) -> list[int]:
        return [int(i) for c in self.words.chunks(text) for i in self.chunk[c][1].split()]

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs; the file names no decoder, so they stand apart."""
        return " ".join(map(self.label.__getitem__, ids))

    def digest(self, text: str) -> tuple[int, str, str]:
        found = list(map(self.chunk.__getitem__, self.words.chunks(text)))
        ids = " ".join([f[1] for f in found])
        decoded = " ".join([f[2] for f in found])
        return (
            sum([f[0] for f in found]),
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(decoded.encode("utf-8")).hexdigest(),
        )


@functools.lru_cache(maxsize=2)
def coder_of(path: str) -> Coder:
    return Coder(words_of(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every row, whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of(path)
        for batch in batches:
            ids = [coder.ids(t) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "ids": ids, "decoded": [coder.decode(i) for i in ids]}
            )

    return texts_of(docs).mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row, whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_of(path)
        for batch in batches:
            found = [coder.digest(t) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_tokens": pd.Series([f[0] for f in found], dtype="int64"),
                    "ids_sha256": [f[1] for f in found],
                    "decoded_sha256": [f[2] for f in found],
                }
            )

    return texts_of(docs).mapInPandas(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
