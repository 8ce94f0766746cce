"""Minimal perfect hashing of 64-bit keys with numpy.

Level by level, the keys left over are hashed into a bit array of ``LOAD`` times their
number; those that have a bit to themselves are placed there, the others go to the next
level.  The index of a key is the number of bits set before its own, over all levels: n keys
get 0 to n - 1.  A key that was not built in gets some index or -1: whoever looks up compares
with the key kept at that index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from wattle.llm.arrays import MULT, U64, mix

LOAD = 2


@dataclass(frozen=True)
class PerfectHash:
    sizes: np.ndarray           # bits of each level, multiples of 64
    words: np.ndarray           # uint64, the levels one after the other

    def __post_init__(self):
        ones = np.bitwise_count(self.words).astype(np.int64)
        object.__setattr__(self, "_before", np.cumsum(ones) - ones)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(keys[left], level, int(size)) + U64(base)
            word, bit = (at >> U64(6)).astype(np.int64), at & U64(63)
            hit = (self.words[word] >> bit) & U64(1) == 1
            lower = self.words[word] & ((U64(1) << bit) - U64(1))
            out[left[hit]] = (self._before[word] + np.bitwise_count(lower))[hit]
            left, base = left[~hit], base + int(size)
        return out


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys + U64((level + 1) * int(MULT) % 2**64)) % U64(size)


def build(keys: np.ndarray) -> PerfectHash:
    """``keys``: distinct uint64 values."""
    sizes, words = [], []
    while len(keys):
        size = -(-LOAD * len(keys) // 64) * 64
        at = _place(keys, len(sizes), size)
        count = np.bincount(at.astype(np.int64), minlength=size)
        words.append(np.packbits(count == 1, bitorder="little").view(np.uint64))
        sizes.append(size)
        keys = keys[count[at.astype(np.int64)] > 1]
        if len(sizes) > 200:
            raise ValueError("the keys are not distinct")
    return PerfectHash(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))
