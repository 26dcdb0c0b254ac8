"""Minimal perfect hashing of 64-bit keys, or of byte strings, by cascaded collision-free bitmaps.

Level by level every remaining key hashes to one cell of a bitmap of GAMMA cells a key; cells hit
exactly once are kept and their keys are placed, the others go on to the next level. A key's slot is the
number of set cells before its own, so n keys fill the slots 0..n-1 and a lookup costs O(1) expected probes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import xxhash

GAMMA = 3
_MUL = np.uint64(0xBF58476D1CE4E5B9)
_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * _STEP & _MASK)
    for shift in (30, 27):
        x = (x ^ (x >> np.uint64(shift))) * _MUL
    return x ^ (x >> np.uint64(31))


class MinimalPerfectHash:
    """Slots of distinct unsigned 64-bit keys; keys that were not put in get -1 or an arbitrary slot."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray):
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        """Over distinct unsigned 64-bit keys, for `lookup`."""
        keys = np.asarray(keys, np.uint64)
        return cls._levels(len(keys), lambda level, left: mix(keys[left], level))

    @classmethod
    def of_bytes(cls, keys: list[bytes]) -> MinimalPerfectHash:
        """Over distinct byte strings, for `find`; the levels hash with their number as seed."""
        return cls._levels(len(keys), lambda level, left: np.array([xxhash.xxh64_intdigest(keys[i], level) for i in left.tolist()], np.uint64))

    @classmethod
    def _levels(cls, n: int, hashed: Callable[[int, np.ndarray], np.ndarray]) -> MinimalPerfectHash:
        left, sizes, cells = np.arange(n), [], []
        while len(left):
            if len(sizes) > 200:
                raise ValueError("keys of a minimal perfect hash must be distinct")
            size = (max(64, GAMMA * len(left)) + 63) // 64 * 64
            at = (hashed(len(sizes), left) % np.uint64(size)).astype(np.int64)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            cells.append(once)
            left = left[~once[at]]
        bits = np.concatenate(cells) if cells else np.zeros(0, bool)
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[:-1].astype(np.int64) if len(words) else np.zeros(0, np.int64)
        return cls(np.array(sizes, np.int64), words, ranks)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        slot, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (mix(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[open_[hit]] = (self.ranks[at >> 6] + below)[hit]
            open_ = open_[~hit]
        return slot

    def find(self, key: bytes) -> int:
        """Slot of one byte string."""
        for level, (size, start) in enumerate(self._spans):
            at = start + xxhash.xxh64_intdigest(key, level) % size
            word = self._words[at >> 6]
            if word >> (at & 63) & 1:
                return self._ranks[at >> 6] + (word & ((1 << (at & 63)) - 1)).bit_count()
        return -1

    @cached_property
    def _spans(self) -> list[tuple[int, int]]:
        return list(zip(self.sizes.tolist(), self.starts.tolist(), strict=False))

    @cached_property
    def _words(self) -> list[int]:
        return self.words.tolist()

    @cached_property
    def _ranks(self) -> list[int]:
        return self.ranks.tolist()

    def arrays(self) -> dict[str, np.ndarray]:
        return {"sizes": self.sizes, "words": self.words, "ranks": self.ranks}
