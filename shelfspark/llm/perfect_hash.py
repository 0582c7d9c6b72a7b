"""Minimal perfect hashes of 64-bit keys: levels of bits, each set where exactly one key falls."""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that is still without a place.
SPREAD = 2.0


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """Mixed bits of the keys, another mix at each level, as places below ``size``."""
    # The multipliers of a public 64-bit mixing function.
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Maps each of n known keys to a number of its own below n. Other keys get any number, or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self._ranks = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def of(cls, keys: np.ndarray, spread: float = SPREAD) -> PerfectHash:
        """The hash of distinct ``keys`` (int64)."""
        sizes, levels = [], []
        while len(keys):
            size = max(8, int(spread * len(keys)))
            places = _places(keys, len(sizes), size)
            held = np.bincount(places, minlength=size)
            sizes.append(size)
            levels.append(held == 1)
            keys = keys[held[places] > 1]
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, dtype=bool))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        open_, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            places = _places(keys[open_], level, size) + start
            hit = self.bits[places]
            out[open_[hit]] = self._ranks[places[hit]]
            open_, start = open_[~hit], start + size
        return out

    def pack(self) -> tuple[list[int], bytes]:
        return self.sizes, np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, sizes: list[int], packed: bytes) -> PerfectHash:
        return cls(sizes, np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=sum(sizes)).astype(bool))


class VerifiedIndex:
    """A perfect hash with its keys in hash order, so that a key it was not built of is noticed."""

    def __init__(self, hashed: PerfectHash, keys: np.ndarray):
        self.hashed, self.keys = hashed, keys

    @classmethod
    def of(cls, keys: np.ndarray) -> VerifiedIndex:
        hashed = PerfectHash.of(keys)
        ordered = np.empty_like(keys)
        ordered[hashed.index(keys)] = keys
        return cls(hashed, ordered)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of known keys; raises KeyError where one is not known."""
        found = self.hashed.index(keys)
        if len(keys) and (found.min() < 0 or (self.keys[found] != keys).any()):
            raise KeyError("a key is not in the index")
        return found
