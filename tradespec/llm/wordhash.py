"""Hashes of the words of UTF-8 texts, for whole arrays of bytes at once."""

from __future__ import annotations

import functools
import hashlib

import numpy as np

#: Bytes hashed at once; a longer word is still hashed as one.
PIECE = 1 << 20
#: The longest word, in bytes, whose pair of hashes comes from tables.
SHORT = 64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=1)
def _of_bytes() -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)


@functools.lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    base = int(_ODD)
    inverse = pow(base, -1, 1 << 64)
    out = []
    for factor in (base, inverse):
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    return x * np.uint64(0xD6E8FEB86659FD93)


def _piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one stretch of bytes."""
    space = _SPACE[raw]
    change = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = change[::2], change[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    size = 1 << max(20, int(len(raw)).bit_length())
    powers, inverses = _powers(size)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_of_bytes()[raw] * powers[: len(raw)], out=sums[1:])
    return starts, ends, mixed((sums[ends] - sums[starts]) * inverses[starts])


@functools.lru_cache(maxsize=1)
def _tables() -> np.ndarray:
    """Two random numbers for every byte at every place of a short word."""
    return np.random.default_rng(61).integers(0, 2**64, (2, SHORT * 256), dtype=np.uint64)


def _pairs(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_piece``, with two hashes a word that share nothing.

    A short word's hash adds up a random number for each of its bytes at its place; a
    longer word's is half of a cryptographic digest.
    """
    space = _SPACE[raw]
    change = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = change[::2], change[1::2]
    hashes = np.empty((len(starts), 2), np.uint64)
    if not len(starts):
        return starts, ends, hashes
    begun = np.zeros(len(raw), np.int64)
    begun[starts] = starts
    place = np.arange(len(raw)) - np.maximum.accumulate(begun)
    place = (np.minimum(place, SHORT - 1) << 8) | raw
    sums = np.zeros(len(raw) + 1, np.uint64)
    for i, table in enumerate(_tables()):
        np.cumsum(table[place], out=sums[1:])
        hashes[:, i] = mixed(sums[ends] - sums[starts])
    for i in np.flatnonzero(ends - starts > SHORT):
        digest = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=16).digest()
        hashes[i] = np.frombuffer(digest, "<u8")
    return starts, ends, hashes


def word_hashes(raw: bytes, of_piece=_piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, byte ends and hashes of all words of a text.

    Words are runs of bytes other than blanks and the controls 0x09 to 0x0D.
    """
    data = np.frombuffer(raw, np.uint8)
    parts, at = [], 0
    while at < len(data):
        stop = min(len(data), at + PIECE)
        while stop < len(data):
            # On to the next white space, so that no word is cut.
            gap = np.flatnonzero(_SPACE[data[stop : stop + PIECE]])
            if len(gap):
                stop += int(gap[0])
                break
            stop = min(len(data), stop + PIECE)
        starts, ends, hashes = of_piece(data[at:stop])
        parts.append((starts + at, ends + at, hashes))
        at = stop
    if not parts:
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def texts_word_hashes(texts: list[bytes], of_piece=_piece) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of many texts in a row, and how many each text has."""
    counts, parts, held, size = [], [], [], 0

    def flush() -> None:
        if held:
            joined = b" ".join(held)
            starts, _, hashes = word_hashes(joined, of_piece)
            edges = np.cumsum([len(t) + 1 for t in held])
            of = np.searchsorted(edges, starts, side="right")
            counts.append(np.bincount(of, minlength=len(held)))
            if len(hashes):
                parts.append(hashes)
            held.clear()

    for text in texts:
        held.append(text)
        size += len(text)
        if size >= PIECE:
            flush()
            size = 0
    flush()
    return (
        np.concatenate(parts) if parts else np.empty(0, np.uint64),
        np.concatenate(counts) if counts else np.empty(0, np.int64),
    )


def texts_word_pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the words of many texts in a row, and how many
    words each text has."""
    pairs, counts = texts_word_hashes(texts, _pairs)
    pairs = pairs.reshape(-1, 2)
    return np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), counts


def windows(hashes: np.ndarray, counts: np.ndarray, size: int, seed: int = 1):
    """Hashes of all runs of ``size`` words within one text, and where they start."""
    number = len(hashes) - size + 1
    if number < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    factor = np.uint64(int(_ODD) * (2 * seed + 1) % (1 << 64) | 1)
    total = np.zeros(number, np.uint64)
    for i in range(size):
        total = total * factor + hashes[i : i + number]
    ends = np.repeat(np.cumsum(counts), counts)
    starts = np.flatnonzero(np.arange(size, number + size) <= ends[:number])
    return mixed(total[starts]), starts
