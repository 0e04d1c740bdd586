"""Secrets in texts: fixed patterns, and stretches of high entropy.

Three patterns find passwords and keys by how they are written. Besides them,
candidate strings are scanned with a window of fixed size for each class of
characters (hexadecimal, base 64). The window's Shannon entropy is kept by counts
that change by one character in and one out; where it reaches the class's
threshold the window belongs to a secret. Stretches on the allow-list (UUIDs,
versions and dates, paths and host names, repeated alphabets) are not reported.

Defined results: null and empty texts have no spans; spans are in code points,
their end exclusive. Entropy spans that touch a pattern's span are not repeated.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespec.llm.common import texts_of

# The patterns of the base spans, each with its least length.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")
MASK = "[SECRET]"

_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ALLOWED = (
    re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE),  # UUIDs
    re.compile(r"[0-9.:_/-]+"),  # numbers, versions, dates
    re.compile(r"[A-Za-z]+([/_-][A-Za-z]+)*"),  # words, paths and names without digits
    re.compile(r"(https?:/)?/?[a-z0-9.-]+(/[a-z._-]*)+"),
    re.compile(r".*(abcdefghij|0123456789|ABCDEFGHIJ).*"),
)


@dataclass(frozen=True)
class EntropyClass:
    """Characters of one class, the window's size and its threshold in bits."""

    characters: frozenset[str]
    window: int
    threshold: float


CLASSES = (
    EntropyClass(frozenset("0123456789abcdefABCDEF"), 20, 3.0),
    EntropyClass(
        frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.7
    ),
)


def entropy_stretches(text: str, group: EntropyClass) -> list[tuple[int, int]]:
    """Where windows of characters of a class reach its threshold; overlaps joined."""
    size = group.window
    term = [0.0, *(n * math.log2(n) for n in range(1, size + 1))]
    counts: Counter = Counter()
    total, inside = 0.0, 0
    found: list[tuple[int, int]] = []
    for at, char in enumerate(text):
        if char not in group.characters:
            counts.clear()
            total, inside = 0.0, 0
            continue
        n = counts[char]
        total += term[n + 1] - term[n]
        counts[char] = n + 1
        inside += 1
        if inside > size:
            gone = text[at - size]
            n = counts[gone]
            total += term[n - 1] - term[n]
            counts[gone] = n - 1
            inside = size
        if inside == size and math.log2(size) - total / size >= group.threshold:
            start = at - size + 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], at + 1)
            else:
                found.append((start, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, place in KINDS, end)`` of the patterns' matches."""
    spans = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        spans += [
            (m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18
        ]
    if _KEYWORD.search(text):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    return sorted(spans)


def entropy_spans(text: str, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further spans, apart from the known ones and from what is allowed."""
    spans: set[tuple[int, int, int]] = set()
    for m in _CANDIDATE.finditer(text):
        word = m[0]
        if word.isalpha() or any(a.fullmatch(word) for a in ALLOWED):
            continue
        for group in CLASSES:
            for start, end in entropy_stretches(word, group):
                part = word[start:end]
                a, b = m.start() + start, m.start() + end
                if (
                    any(c.isdigit() for c in part)
                    and not any(x.fullmatch(part) for x in ALLOWED)
                    and not any(s < b and a < e for s, _, e in known)
                ):
                    spans.add((a, 3, b))
    joined: list[tuple[int, int, int]] = []
    for a, kind, b in sorted(spans):
        if joined and a < joined[-1][2]:
            joined[-1] = (joined[-1][0], kind, max(b, joined[-1][2]))
        else:
            joined.append((a, kind, b))
    return joined


def spans_of(text: str) -> tuple[list, list]:
    """Base spans and all spans of a text."""
    base = base_spans(text)
    return base, sorted(base + entropy_spans(text, base))


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def masked(text: str) -> str:
    """A text with every span replaced by :data:`MASK`."""
    parts, at = [], 0
    for start, _, end in spans_of(text)[1]:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [spans_of(t) for t in batch["text"]]
            kinds = [Counter(k for _, k, _ in base) for base, _ in found]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    **{
                        f"n_{KINDS[k]}": pd.Series([c[k] for c in kinds], dtype="int64")
                        for k in range(3)
                    },
                    "base_sha256": [hashlib.sha256(as_text(b).encode()).hexdigest() for b, _ in found],
                    "spans": [as_text(s) for _, s in found],
                }
            )

    return texts_of(docs).mapInPandas(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the spans masked in ``text``; null texts stay null."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: None if t is None else masked(t))

    return docs.withColumn("text", F.pandas_udf(run, "string")(F.col("text").cast("string")))
