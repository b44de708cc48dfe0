"""A minimal perfect hash of distinct 64-bit keys, in numpy.

Level after level, the keys left over are dealt to twice as many bits; a bit that exactly one
key meets is set and that key is done. A key's index is the number of set bits before its own,
so n keys get the indexes 0 to n - 1. A key outside the set gets some index or -1: whoever looks
up compares the key stored at the index.
"""

from __future__ import annotations

import numpy as np

from . import common

# Bits of a level per key that is left, at least; a level's words are a power of two.
ROOM = 2
_SEED = 0x9E3779B97F4A7C15


def _slots(keys: np.ndarray, level: int, words: int) -> np.ndarray:
    """The bit of each key: the upper bits of its hash, as many as number the level's bits."""
    seed = np.uint64(_SEED * (level + 1) & 0xFFFFFFFFFFFFFFFF)
    return (common.mix(keys ^ seed) >> np.uint64(65 - (64 * words).bit_length())).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        """``sizes`` holds the 64-bit words of each level, ``words`` the levels' bits."""
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of distinct uint64 keys."""
        sizes, levels, left = [], [], keys
        while len(left):
            words = 1 << (-(-ROOM * len(left) // 64) - 1).bit_length()
            slots = _slots(left, len(sizes), words)
            single = np.bincount(slots, minlength=64 * words) == 1
            sizes.append(words)
            levels.append(np.packbits(single, bitorder="little").view(np.uint64))
            left = left[~single[slots]]
        words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
        return cls(np.array(sizes, dtype=np.int64), words)

    def index(self, keys: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            slots = _slots(keys[left], level, size)
            at = self.starts[level] + (slots >> 6)
            word, bit = self.words[at], (slots & 63).astype(np.uint64)
            hit = ((word >> bit) & np.uint64(1)).astype(bool)
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            found[left[hit]] = (self.before[at] + np.bitwise_count(below))[hit]
            left = left[~hit]
        return found
