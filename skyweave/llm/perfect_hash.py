"""A minimal perfect hash: n distinct 64-bit keys to the slots 0 .. n - 1.

Keys are dealt to a field of bits; those alone at their bit are done, the
others go on to a smaller field.  A key's slot is the number of bits set
before its own.  About four bits a key; beside them the keys themselves are
stored by slot, so that a key that isn't in the set is told from one that is.
"""

from __future__ import annotations

import numpy as np

_SPARSE = 2  # bits in a field for each key that reaches it
_STEP = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Other bits of the same keys at each level, none lost."""
    x = keys + np.uint64(_STEP * (level + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """The slots of ``keys``, distinct numbers of 64 bits."""

    def __init__(self, keys: np.ndarray):
        rest = np.asarray(keys, np.uint64)
        fields, self._starts, self._sizes = [], [], []
        start = 0
        while len(rest):
            size = (len(rest) * _SPARSE + 63) // 64 * 64
            at = (mixed(rest, len(fields)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            fields.append(np.packbits(alone, bitorder="little").view(np.uint64))
            self._starts.append(start)
            self._sizes.append(size)
            start += size
            rest = rest[~alone[at]]
        self._bits = np.concatenate([*fields, np.zeros(0, np.uint64)])
        counts = np.bitwise_count(self._bits).astype(np.int64)
        self._before = np.cumsum(counts) - counts
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self._slots(np.asarray(keys, np.uint64))] = keys

    def __len__(self) -> int:
        return len(self.keys)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """A slot for every key, of keys that aren't in the set any or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (start, size) in enumerate(zip(self._starts, self._sizes, strict=True)):
            if not len(todo):
                break
            at = (mixed(keys[todo], level) % np.uint64(size)).astype(np.int64) + start
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            bits = self._bits[word]
            hit = (bits >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(bits & ((np.uint64(1) << bit) - np.uint64(1)))
            out[todo[hit]] = (self._before[word] + below)[hit]
            todo = todo[~hit]
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' slots, -1 for keys that aren't in the set."""
        keys = np.asarray(keys, np.uint64)
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slots = self._slots(keys)
        slots[self.keys[slots] != keys] = -1
        return slots
