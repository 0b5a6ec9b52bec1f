"""A keyed permutation of 0 .. n-1 by a Feistel network with cycle-walking."""

from __future__ import annotations

import numpy as np

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser as the round function."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each index of 0 .. n-1 goes; a bijection for every n and key.

    The network permutes the least power of four that holds n; what falls
    outside 0 .. n-1 walks on along its cycle until it is inside, which takes
    fewer than four steps on average."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [((key + r + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1) for r in range(ROUNDS)]
    out = np.asarray(index, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        x = (left << half) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)
