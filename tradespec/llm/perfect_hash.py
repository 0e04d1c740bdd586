"""Minimal perfect hashing of 64-bit keys, with the keys kept for verification.

Level by level, every key left picks a bit of a fresh bitmap; keys that are alone on
their bit stay there and the others go on to the next level. A key's number is the
count of bits set before its own, so n keys have the numbers 0 to n - 1.
"""

from __future__ import annotations

import numpy as np

_LEVELS = 64


def scrambled(keys: np.ndarray, turn: int) -> np.ndarray:
    """Keys as well-spread 64-bit numbers, other ones for every ``turn``."""
    x = keys.astype(np.uint64) + np.uint64((turn * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0 to n - 1 for n distinct keys; other keys are found out and get -1."""

    def __init__(self, keys: np.ndarray):
        """``keys`` are distinct unsigned 64-bit numbers."""
        left = np.asarray(keys, np.uint64)
        self.bits: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        numbered = 0
        while len(left):
            if len(self.bits) == _LEVELS:
                raise ValueError("keys are not distinct")
            places = self._places(left, len(self.bits), 2 * len(left))
            often = np.bincount(places, minlength=2 * len(left))
            alone = often == 1
            self.bits.append(alone)
            self.before.append(numbered + np.cumsum(alone) - alone)
            numbered += int(alone.sum())
            left = left[~alone[places]]
        self.keys = np.zeros(numbered, np.uint64)
        if numbered:
            self.keys[self._numbers(np.asarray(keys, np.uint64))] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (scrambled(keys, level) % np.uint64(size)).astype(np.int64)

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before)):
            places = self._places(keys[left], level, len(bits))
            here = bits[places]
            out[left[here]] = before[places[here]]
            left = left[~here]
            if not len(left):
                break
        return out

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that were not given."""
        keys = np.asarray(keys, np.uint64)
        found = self._numbers(keys)
        if len(self.keys):
            found[(found >= 0) & (self.keys[found] != keys)] = -1
        return found
