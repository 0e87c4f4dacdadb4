"""Random orders that any engine gives alike: rows are ordered by a digest of seed, replicate and id.

Sorting by independent uniform keys is a uniform permutation. Keys depend on the row alone, so
partitions and retries don't matter, and shuffles stay plain window functions of Spark.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def key(seed: int, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def uniform(seed: int, *columns: str) -> Column:
    """A number in (0, 1), by the digest's first eight digits."""
    return (F.conv(F.substring(key(seed, *columns), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(seed: int, *columns: str) -> Column:
    """A standard normal number, from two uniform ones (seeds `seed` and `seed + 1`)."""
    return F.sqrt(-2 * F.log(uniform(seed, *columns))) * F.cos(2 * F.pi() * uniform(seed + 1, *columns))


def poisson_steps(mean: float) -> list[float]:
    """Where a uniform number must be beyond for a Poisson one of 1, 2, ... to be reached."""
    p, total, out = math.exp(-mean), 0.0, []
    for k in range(int(mean + 12 * math.sqrt(mean) + 20)):
        total += p
        out.append(min(total, 1.0))
        p *= mean / (k + 1)
    return out


def poisson(mean: float, seed: int, *columns: str) -> Column:
    """A Poisson number by the inverse of its distribution."""
    u = uniform(seed, *columns)
    return F.size(F.filter(F.array(*map(F.lit, poisson_steps(mean))), lambda c: c < u))


def replicates(df: DataFrame, n: int, name: str = "replicate") -> DataFrame:
    """Each row n times, numbered from 1."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def shuffled(rows: DataFrame, within: Sequence[str], ids: Sequence[str], values: Sequence[str], n: int, seed: int) -> DataFrame:
    """n copies of the rows whose `values` are shuffled within groups: within, ids, replicate, values.

    A row's place is its rank by ids; the values of the row that is drawn at this place go to it.
    """
    placed = rows.select(*within, *ids, F.row_number().over(Window.partitionBy(*within).orderBy(*ids)).alias("_place"))
    many = replicates(rows.select(*within, *ids, *values), n).withColumn("_key", key(seed, "replicate", *ids))
    drawn = many.select(*within, "replicate", *values, F.row_number().over(Window.partitionBy(*within, "replicate").orderBy("_key", *ids)).alias("_place"))
    return drawn.join(placed, [*within, "_place"]).drop("_place")


def two_sided(z: Column) -> Column:
    """Normal tail probability of |z|, both sides: the complementary error function by a Chebyshev
    fit with a relative error below 1.2e-7."""
    return complementary_error(F.abs(z) / 2**0.5)


def upper_tail(z: Column) -> Column:
    tail = complementary_error(F.abs(z) / 2**0.5) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


#: Fixed values of the fit.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def complementary_error(x: Column) -> Column:
    """erfc of x >= 0."""
    t, poly = 1 / (1 + x / 2), F.lit(0.0)
    for c in reversed(ERFC):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def complementary_error_sql(x: str) -> str:
    t, poly = f"(1 / (1 + ({x}) / 2))", "0.0"
    for c in reversed(ERFC):
        poly = f"({poly} * {t} + ({c}))"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


#: Of MD5: how far each of the 64 steps rotates, its constant, and where it starts.
_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINE = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_START = [np.uint32(c) for c in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
#: Digests that are worked on together, so that they stay in the cache.
_TOGETHER = 16384


def _compress(word: list, shape: tuple[int, int]) -> list[np.ndarray]:
    """The four words of MD5 of messages of one block; word: its sixteen words, each a number or an array."""
    a, b, c, d = (np.full(shape, v) for v in _START)
    f, t = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, word[g] + _SINE[i], out=f)
        np.left_shift(f, np.uint32(_TURN[i]), out=t)
        np.right_shift(f, np.uint32(32 - _TURN[i]), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    return [v + s for v, s in zip((a, b, c, d), _START)]


def digests(heads: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """MD5 of each head followed by each tail: [head, tail, 16 bytes]. Messages of one block of MD5 are
    worked out side by side, each in the same steps."""
    out = np.empty((len(heads), len(tails), 4), "<u4")
    if not out.size:
        return out.view(np.uint8)
    size = np.array([len(t) for t in tails])
    if len(heads) * len(tails) < 512 or max(map(len, heads)) + size.max() > 55:
        flat = b"".join(hashlib.md5(h + t).digest() for h in heads for t in tails)
        return np.frombuffer(flat, np.uint8).reshape(len(heads), len(tails), 16)
    text = np.array(tails, f"S{size.max()}").view(np.uint8).reshape(len(tails), -1)
    place = np.arange(len(tails))
    for n in sorted({len(h) for h in heads}):
        own = np.array([k for k, h in enumerate(heads) if len(h) == n])
        block = np.zeros((len(tails), 64), np.uint8)
        block[:, n : n + text.shape[1]] = text
        block[place, n + size] = 128
        bits = (8 * (n + size)).astype("<u2")
        block[:, 56:58] = bits.view(np.uint8).reshape(-1, 2)
        words = np.ascontiguousarray(block.view("<u4").T)
        front = np.zeros((len(own), 64), np.uint8)
        front[:, :n] = np.frombuffer(b"".join(heads[k] for k in own), np.uint8).reshape(len(own), n)
        front = front.view("<u4")
        wide = min(len(tails), _TOGETHER)
        high = max(1, _TOGETHER // wide)
        same = [w[0] if (w == w[0]).all() else None for w in words]
        for s in range(0, len(tails), wide):
            for r in range(0, len(own), high):
                rows, cols = own[r : r + high], slice(s, min(s + wide, len(tails)))
                word: list = []
                for k in range(16):
                    w = words[k, None, cols] if same[k] is None else same[k]
                    word.append(front[r : r + high, k, None] | w if 4 * k < n else w)
                for k, v in enumerate(_compress(word, (len(rows), cols.stop - s))):
                    out[rows, cols, k] = v
    return out.view(np.uint8)


def _texts(ids: Sequence) -> list[bytes]:
    return [f":{i}".encode() for i in ids]


def _sorted_by(keys: np.ndarray) -> np.ndarray:
    """[replicate, place] -> the id at that place in order of its digest, ties in order of the ids."""
    first = keys[..., :8].copy().view(">u8")[..., 0].astype(np.uint64)
    order = np.argsort(first, axis=1)
    held = np.take_along_axis(first, order, 1)
    for r in np.flatnonzero((held[:, 1:] == held[:, :-1]).any(1)):
        order[r] = np.lexsort(keys[r, :, ::-1].T)
    return order


def orders(ids: Sequence, seed: int, n: int, groups: np.ndarray | None = None, first: int = 1) -> np.ndarray:
    """The shuffles of `shuffled` for one group's ids in order: [replicate, place] -> the row that is drawn,
    n replicates from `first`.

    With groups (a number for each id, below zero for none) shuffles stay within them; a place without
    a group draws no row, -1.
    """
    out = np.empty((n, len(ids)), np.int64)
    tails, high = _texts(ids), max(1, (1 << 20) // max(1, len(ids)))
    for s in range(0, n, high):
        keys = digests([f"{seed}:{r + first}".encode() for r in range(s, min(n, s + high))], tails)
        if groups is None:
            out[s : s + high] = _sorted_by(keys)
            continue
        for g in np.unique(groups):
            at = np.flatnonzero(groups == g)
            out[s : s + high, at] = -1 if g < 0 else at[_sorted_by(keys[:, at])]
    return out


def uniform_rows(heads: Sequence[str], ids: Sequence) -> np.ndarray:
    """[head, id]: `uniform` of the columns that head and id are the texts of, the seed first."""
    keys = digests([h.encode() for h in heads], _texts(ids))
    return (keys[..., :4].copy().view(">u4")[..., 0].astype(np.float64) + 0.5) / 4294967296.0


def uniforms(ids: Sequence, seed: int, n: int, first: int = 1) -> np.ndarray:
    """[replicate, id]: `uniform` of replicate and id, n replicates from `first`."""
    return uniform_rows([f"{seed}:{r + first}" for r in range(n)], ids).reshape(n, len(ids))
