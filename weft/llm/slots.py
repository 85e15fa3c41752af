"""Minimal perfect hash tables over distinct 128-bit keys, in numpy.

Every level deals the keys that are left to a few more places than there are keys; a key alone at
its place keeps it, the others go on to the next level. The n-th taken place is slot n, so slots are 0 to
n - 1 without gaps. A lookup compares the key with the one that owns the slot.
"""

from __future__ import annotations

import numpy as np

#: Places per key left at a level.
ROOM = 1.5


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SlotTable:
    """Slots of distinct keys (two uint64 arrays). ``first`` and ``second`` hold each slot's key."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        n = len(first)
        self.levels: list[np.ndarray] = []  # the slot at each place, -1 for none
        self.first, self.second = np.empty(n, np.uint64), np.empty(n, np.uint64)
        used = 0
        while len(first):
            if len(self.levels) == 200:
                raise ValueError("keys of a slot table must be distinct")
            size = int(ROOM * len(first)) + 1
            at = self.place(first, second, len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            taken = np.full(size, -1, np.int64)
            taken[np.sort(at[alone])] = np.arange(used, used + int(alone.sum()))
            slot = taken[at[alone]]
            self.first[slot], self.second[slot] = first[alone], second[alone]
            used += len(slot)
            self.levels.append(taken)
            first, second = first[~alone], second[~alone]

    @staticmethod
    def place(first: np.ndarray, second: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        return (mix(first ^ mix(second + seed)) % np.uint64(size)).astype(np.int64)

    def __len__(self) -> int:
        return len(self.first)

    def slots(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of every key, -1 for one that isn't in the table."""
        out = np.full(len(first), -1, np.int64)
        left = np.arange(len(first))
        for level, taken in enumerate(self.levels):
            if not len(left):
                break
            found = taken[self.place(first[left], second[left], level, len(taken))]
            hit = found >= 0
            mine = left[hit]
            same = (self.first[found[hit]] == first[mine]) & (self.second[found[hit]] == second[mine])
            out[mine[same]] = found[hit][same]
            left = left[~hit]
        return out
