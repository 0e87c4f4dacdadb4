"""Seeded streams that depend on seed, endpoint and replicate only, never on partitions."""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1


def splitmix64(x):
    """One step of the public SplitMix64 generator, on ints or uint64 arrays."""
    if isinstance(x, np.ndarray):
        with np.errstate(over="ignore"):
            z = x + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(31))
    z = (x + 0x9E3779B97F4A7C15) & _MASK
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return z ^ (z >> 31)


def shuffles(n: int, seeds: np.ndarray) -> np.ndarray:
    """One Fisher-Yates order of 0..n-1 for each seed, all replicates swapped together."""
    state, out = seeds.astype(np.uint64).copy(), np.tile(np.arange(n), (len(seeds), 1))
    rows = np.arange(len(seeds))
    for i in range(n - 1, 0, -1):
        state = splitmix64(state ^ np.uint64(i))
        j = (state % np.uint64(i + 1)).astype(np.int64)
        out[rows, i], out[rows, j] = out[rows, j], out[rows, i].copy()
    return out


def replicate_seeds(seed: int, tag: int, replicates: int) -> np.ndarray:
    base = splitmix64((seed ^ tag) & _MASK)
    return splitmix64(np.arange(replicates, dtype=np.uint64) ^ np.uint64(base))
