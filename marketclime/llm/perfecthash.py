"""Minimal perfect hashing of 32-bit keys, by levels of collision-free bits.

At each level the keys that are left are hashed into twice as many bits; a bit
that exactly one key hits is set and that key is placed, the others go on to
the next level. A key's index is the number of set bits before its own. A key
that was not in the set gets some index or none, so callers compare the key
stored there.
"""

from __future__ import annotations

import numpy as np

from marketclime.llm.textbytes import mix

LEVELS = 48  # each level places more than half of what is left; the rest after the last is looked up by search
GAMMA = 2


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))


class PerfectHash:
    """Maps ``n`` distinct keys to 0 .. n - 1. ``bits`` holds all levels one after the other."""

    def __init__(self, keys: np.ndarray):
        left, bits, self.sizes = np.unique(keys), [], []
        self.n = left.size
        for level in range(LEVELS):
            if not left.size:
                break
            size = max(64, (GAMMA * left.size + 63) // 64 * 64)
            place = (_hash(left, level) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(place, minlength=size)
            bits.append(hits == 1)
            self.sizes.append(size)
            left = left[hits[place] != 1]
        self.rest = left
        flat = np.concatenate(bits) if bits else np.zeros(0, bool)
        self.bits = np.packbits(flat, bitorder="little")
        words = np.bitwise_count(self.bits.view(np.uint64)) if flat.size else np.zeros(0, np.uint8)
        self.before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])  # set bits before each 64

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, -1 for some keys that are not in the set."""
        out = np.full(keys.size, -1, np.int64)
        left, base = np.arange(keys.size), 0
        words = self.bits.view(np.uint64)
        for level, size in enumerate(self.sizes):
            if not left.size:
                return out
            place = base + (_hash(keys[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[place >> 6], (place & 63).astype(np.uint64)
            there = (word >> bit & np.uint64(1)).astype(bool)
            under = word[there] & ((np.uint64(1) << bit[there]) - np.uint64(1))
            out[left[there]] = self.before[place[there] >> 6] + np.bitwise_count(under)
            left, base = left[~there], base + size
        if left.size and self.rest.size:
            at = np.minimum(np.searchsorted(self.rest, keys[left]), self.rest.size - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = self.n - self.rest.size + at[same]
        return out
