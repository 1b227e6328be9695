"""Polynomial hashes of byte strings modulo the prime 2^61 - 1, for all windows of an array at once.

Two different strings of at most n bytes have equal hashes for at most n of the 2^61 bases, whatever the strings are; bases
come from a seed that a run draws on the driver (``drawn``), so no text can be made to collide."""
from __future__ import annotations

import secrets

import numpy as np

PRIME = (1 << 61) - 1
_U = np.uint64
#: Bytes that a running sum may cover before it could pass 64 bits.
REACH = 1 << 23


def drawn() -> int:
    """A seed that cannot be foreseen."""
    return secrets.randbits(62)


def reduced(t: np.ndarray) -> np.ndarray:
    t = (t & _U(PRIME)) + (t >> _U(61))
    return np.where(t >= _U(PRIME), t - _U(PRIME), t)


def times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products modulo the prime, by halves of 31 bits (2^61 is 1)."""
    x1, x0, y1, y0 = x >> _U(31), x & _U((1 << 31) - 1), y >> _U(31), y & _U((1 << 31) - 1)
    mid = x1 * y0 + x0 * y1
    return reduced((x1 * y1 << _U(1)) + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << _U(31)) + x0 * y0)


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.r_[out, times(out, _U(pow(base, len(out), PRIME)))]
    return out[:n]


class Polynomial:
    """One hash: the byte values (from 1) as coefficients of the powers of a base, spread over 64 bits one to one."""

    def __init__(self, rng: np.random.Generator, reach: int):
        base = int(rng.integers(1 << 32, PRIME - 1))
        self.up, self.down = powers(base, reach + 1), powers(pow(base, -1, PRIME), reach + 1)
        self.mix = _U(int(rng.integers(0, 1 << 62)) * 2 + 1)

    def windows(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ``part[starts:ends]``; ``part`` has at most ``reach`` bytes, and that at most ``REACH``."""
        coefficient, up = part.astype(np.uint64) + _U(1), self.up[:len(part)]
        low, high = np.zeros(len(part) + 1, np.uint64), np.zeros(len(part) + 1, np.uint64)
        np.cumsum(coefficient * (up & _U((1 << 32) - 1)), out=low[1:])
        np.cumsum(coefficient * (up >> _U(32)), out=high[1:])
        a, b = low[ends] - low[starts], high[ends] - high[starts]
        h = times(reduced(a + (b >> _U(29)) + ((b & _U((1 << 29) - 1)) << _U(32))), self.down[starts])
        h ^= h >> _U(29)
        h *= self.mix
        h ^= h >> _U(32)
        return h
