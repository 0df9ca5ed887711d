"""Rolling hashes over bytes in numpy: a gear hash, substring fingerprints and sliding minima."""

from __future__ import annotations

import numpy as np

_R = np.random.default_rng(2024)
GEAR = _R.integers(0, 2**32, 256, dtype=np.uint32)
_VALUES = _R.integers(1, 2**63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15 | 5, 0xD6E8FEB86659FD93 | 5)
HISTORY = 32


def gear(raw: np.ndarray) -> np.ndarray:
    """h[j] = 2 h[j - 1] + GEAR[raw[j]] modulo 2^32, so of the last 32 bytes, by five doublings."""
    h = GEAR[raw]
    for i in range(5):
        step = 1 << i
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    return h


def scramble(h: np.ndarray) -> np.ndarray:
    """An order of gear hashes that doesn't follow the last bytes."""
    h = h * np.uint32(0x9E3779B1)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
    return h ^ (h >> np.uint32(13))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of so many elements."""
    n, step = len(x) - width + 1, 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of two odd bases and of their inverses, modulo 2^64, as far as asked for."""

    def __init__(self):
        self.size, self.of = 0, ()

    def grow(self, n: int) -> tuple:
        if n > self.size:
            self.size = max(1 << 16, 1 << (n - 1).bit_length())
            out = []
            for base in _BASES:
                for b in (base, pow(base, -1, 1 << 64)):
                    steps = np.full(self.size, b, np.uint64)
                    steps[0] = 1
                    out.append(np.multiply.accumulate(steps))
            self.of = tuple(out)
        return self.of


_POWERS = Powers()


class Prints:
    """Two independent 64-bit fingerprints of any substring of one text, from prefix sums."""

    def __init__(self, raw: np.ndarray):
        powers = _POWERS.grow(len(raw) + 1)
        self.sums, self.down = [], (powers[1], powers[3])
        for i in range(2):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_VALUES[i][raw] * powers[2 * i][: len(raw)], out=sums[1:])
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        h = (self.sums[which][end] - self.sums[which][start]) * self.down[which][start]
        return mix64(h + (end - start).astype(np.uint64))
