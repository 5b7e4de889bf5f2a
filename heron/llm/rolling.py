"""Vectorised 64-bit polynomial hashes of byte ranges, shared by the deduplication operators."""

from __future__ import annotations

import numpy as np

#: An odd base is invertible modulo 2 ** 64, so a range's hash is a difference of prefix sums.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n; kept and grown by doubling."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE ** position, one longer than data."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of data[start:end]; equal ranges have equal hashes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(INVERSE, len(sums))[start] + (end - start).astype(np.uint64))
