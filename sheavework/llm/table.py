"""A hash table of 64-bit keys for lookups of whole arrays, by open addressing."""

from __future__ import annotations

import numpy as np

from . import bulk


class KeyTable:
    """Numbers of known keys; -1 for others. Keys are distinct."""

    def __init__(self, keys: np.ndarray) -> None:
        self.mask = (1 << max(4, int(len(keys) * 3).bit_length())) - 1
        self.keys = np.zeros(self.mask + 1, np.uint64)
        self.numbers = np.full(self.mask + 1, -1, np.int64)
        todo = np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = np.flatnonzero(self.numbers[slot[todo]] < 0)
            won = todo[free[np.unique(slot[todo[free]], return_index=True)[1]]]
            self.keys[slot[won]], self.numbers[slot[won]] = keys[won], won
            rest = np.ones(len(keys), bool)
            rest[won] = False
            todo = todo[rest[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (bulk.mix(keys) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.numbers[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            found[wrong] = self.numbers[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return found
