"""64-bit hashing of bytes in numpy, all arithmetic modulo 2**64."""

from __future__ import annotations

import numpy as np

_U = np.uint64
ODD = _U(0x9E3779B97F4A7C15)
BASES = (0x5851F42D4C957F2D, 0xDA942042E4DD58B5)

_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of an odd base, or of its inverse."""
    if len(_powers.get((base, inverse), ())) < n:
        steps = np.full(max(n, 1 << 16), _U(pow(base, -1, 1 << 64) if inverse else base), np.uint64)
        steps[0] = _U(1)
        _powers[base, inverse] = np.multiply.accumulate(steps)
    return _powers[base, inverse][:n]


class Ranges:
    """Hashes of any byte ranges of ``data``, from prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        self.base, self.size = base, len(data)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + _U(1)) * powers(base, len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * powers(self.base, self.size + 1, True)[starts]
        return mix(value + (ends - starts).astype(np.uint64) * ODD)
