"""Vectorised 64-bit hashes of byte ranges, by prefix sums modulo 2**64."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd**i and odd**-i for i below n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 20)
        back = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, base in (("up", _ODD), ("down", back)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking word for each byte value.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of data[s:e] for each range, by content and length alone. data: bytes. Ranges may lie anywhere."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _ODD)


class Known:
    """A hash table from 64-bit keys to row numbers, looked up and filled by whole arrays."""

    def __init__(self, bits: int = 22):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        self.size = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if unknown."""
        slot = (keys >> self.shift).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.rows[slot], -2).astype(np.int32)
        out[(out == -2) & (self.rows[slot] == -1)] = -1
        left = np.flatnonzero(out == -2)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            rows = self.rows[slot]
            found = np.where(self.keys[slot] == keys[left], rows, -2)
            found[rows == -1] = -1
            out[left] = found
            left, slot = left[found == -2], slot[found == -2]
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that are not yet known."""
        self.size += len(keys)
        slot = (keys >> self.shift).astype(np.int64)
        while len(keys):
            _, first = np.unique(slot, return_index=True)
            can = np.zeros(len(keys), bool)
            can[first] = self.rows[slot[first]] == -1
            self.keys[slot[can]], self.rows[slot[can]] = keys[can], rows[can]
            keys, rows, slot = keys[~can], rows[~can], (slot[~can] + 1) & self.mask
