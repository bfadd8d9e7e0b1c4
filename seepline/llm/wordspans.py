"""Where the words of texts stand in their bytes, and hashes of runs of words, by whole arrays."""

from __future__ import annotations

import numpy as np

from .hashing import _powers, mix, range_hashes

_C = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are part of a word: all but white space; digits, small ASCII letters and all beyond ASCII.
SOLID = np.ones(256, bool)
SOLID[[*range(9, 14), 32]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each followed by a blank, and where each begins (and the end)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b" ".join([*raw, b""]), np.uint8), np.cumsum([0] + [len(r) + 1 for r in raw])


def words(data: np.ndarray, edges: np.ndarray, part: np.ndarray = SOLID) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes in `part`), and the number of the first word of each text (and of all)."""
    inside = np.concatenate([[False], part[data], [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])
    return starts, ends, np.searchsorted(starts, edges)


class Runs:
    """Hashes of runs of consecutive words. Two salts give two independent hashes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.words = range_hashes(data, starts, ends)
        self._sums: dict[int, np.ndarray] = {}

    def hashes(self, first: np.ndarray, end: np.ndarray, salt: int) -> np.ndarray:
        """A hash of the words first..end-1 of each pair, by their number and contents alone."""
        up, down = _powers(len(self.words) + 1)
        if salt not in self._sums:
            total = np.zeros(len(self.words) + 1, np.uint64)
            offset = np.uint64(salt * int(_C) & 0xFFFFFFFFFFFFFFFF)
            np.cumsum(mix(self.words + offset) * up[: len(self.words)], out=total[1:])
            self._sums[salt] = total
        total = self._sums[salt]
        return mix((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64) * _C + np.uint64(salt))
