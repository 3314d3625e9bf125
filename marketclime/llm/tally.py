"""Counts of 64-bit keys kept in numpy while a task reads its rows."""

from __future__ import annotations

import numpy as np


class Tally:
    """Adds up counts of keys; ``full`` tells when to hand them on, so memory stays bounded."""

    def __init__(self, limit: int = 1 << 20):
        self.limit = limit
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if keys.size:
            self.parts.append((keys, counts))
            self.size += keys.size
            if self.size > 2 * self.limit:
                self._fold()

    def _fold(self) -> None:
        keys, counts = added(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))
        self.parts, self.size = [(keys, counts)], keys.size

    @property
    def full(self) -> bool:
        return self.size > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys in order and their counts; the tally is empty afterwards."""
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._fold()
        out = self.parts[0]
        self.parts, self.size = [], 0
        return out


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts summed."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.ones(keys.size, bool)
    first[1:] = keys[1:] != keys[:-1]
    places = np.flatnonzero(first)
    return keys[places], np.add.reduceat(counts, places) if places.size else counts.astype(np.int64)
