"""Removal of long repeated strings by prefix-free parsing and suffix arrays.

A rolling hash over short grams chooses triggers: the trigger of a `length`-byte window is the
smallest gram hash among its first SPAN grams, so equal windows have their trigger at the same
place inside. Window starts that share a trigger form a phrase. The dictionary holds one row per
distinct phrase with all bytes that its windows touch, by their digest; the parse is the phrases'
places in the texts. A phrase that the parse holds more than once is repeated whole.

Other windows can only equal windows of another phrase with the same core, the bytes that all
windows of a phrase share. One phrase of each digest is dealt by its core, so equal windows meet
in one partition. There the phrases' texts are parsed once more, at prefix-free triggers; suffix
arrays of that dictionary and that parse combine into corpus order (parsing.py), where equal windows
are neighbours and are compared byte by byte. Cores are dealt only as long as they have at most
GROUP phrases. Phrases of any other core are cut into blocks of BLOCK window starts, whose cores
are longer, and what is still common after that into single windows, which are plain digests and
need no dealing: they are counted by an aggregate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut
from .parsing import repeated_places

LENGTH, GRAM, BLOCK = 400, 16, 16
#: Bytes of a text that are hashed at once; longer texts overlap their segments.
SEGMENT = 1_000_000
#: Phrases of one core that a task orders; bytes that it orders together.
GROUP, ORDERED = 8192, 4_000_000
#: Keys that more than one in so many rows has are joined by broadcast: there are fewer than that.
HOT = 4096
_BASE = 0x9E3779B97F4A7C15
_KEYS = ["r1", "r2"]
_ITEM = "r1 long, r2 long, a int, b int, m int, k long, o binary"


@lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class Hasher:
    """Polynomial hashes, modulo 2^64, of any ranges of a buffer: to choose triggers and to deal
    phrases by; equality is never taken from them."""

    def __init__(self, data: bytes):
        size = 1 << max(20, (len(data) + 1).bit_length())
        table = np.random.default_rng(1000).integers(0, 1 << 64, 256, dtype=np.uint64)
        raw = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * _powers(_BASE, size)[: len(raw)], out=self.sums[1:])
        self.back = _powers(pow(_BASE, -1, 1 << 64), size)

    def __call__(self, a, b) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.back[a]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for each i that has so many."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _span(length: int) -> int:
    """Grams among which a window's trigger is chosen; the rest of the window is the phrase's core."""
    return max(1, length * 3 // 4)


def _digests(data: bytes, a: np.ndarray, e: np.ndarray) -> list[bytes]:
    return [hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(a.tolist(), e.tolist())]


def phrases(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """a, b (first and last window start), m (trigger), core and digest of each phrase of a buffer."""
    span = _span(length)
    gram, n = max(1, min(GRAM, length - span)), len(data) - length + 1
    hasher = Hasher(data)
    at = np.arange(n + span - 1)
    bits = np.uint64((SEGMENT + 2 * length).bit_length())  # the same for any buffer
    order = (hasher(at, at + gram) >> bits << bits) | at.astype(np.uint64)
    m = (_sliding_min(order, span) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    a = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    b = np.concatenate([a[1:], [n]]) - 1
    m = m[a]
    return a, b, m, hasher(m, m + length - span + 1), _digests(data, a, b + length)


def _emit(keys, found: list[tuple]) -> pa.RecordBatch:
    """keys: r1, r2 columns; found: (row, a, b, m, core, digests) of each."""
    rows = pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]) if found else [], pa.int64())
    cols = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(1, 5)]
    arrays = [k.take(rows) for k in keys] + [pa.array(c.astype(np.int32)) for c in cols[:3]]
    arrays += [pa.array(cols[3].astype(np.uint64).view(np.int64)), pa.array([d for f in found for d in f[5]], pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _ITEM.split(", ")])


def _all_phrases(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for i, x in enumerate(batch.column(2)):
                data = x.as_py() or b""
                for s in range(0, max(0, len(data) - length + 1), SEGMENT):
                    a, b, m, *rest = phrases(data[s : s + SEGMENT + length - 1], length)
                    found.append((i, a + s, b + s, m + s, *rest))
                    held += len(a)
                if held > 200_000:
                    yield _emit(batch.columns[:2], found)
                    found, held = [], 0
            yield _emit(batch.columns[:2], found)

    return docs.select(*_KEYS, "bytes").mapInArrow(run, _ITEM)


def _narrower(texts: DataFrame, todo: DataFrame, length: int, block: int) -> DataFrame:
    """The parts of todo's items: blocks of `block` window starts counted from the trigger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [], 0
            for i in range(batch.num_rows):
                data, items = batch.column(2)[i].as_py(), batch.column(3)[i].values
                a, b, m = (np.asarray(items.field(k), np.int64) for k in range(3))
                first, last = (m - b) // block, (m - a) // block
                n = last - first + 1
                of = np.repeat(np.arange(len(a)), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[of]
                high = m[of] - step * block
                lo, hi, m = np.maximum(a[of], high - block + 1), np.minimum(b[of], high), m[of]
                for s in range(0, len(data), SEGMENT):
                    own = (lo >= s) & (lo < s + SEGMENT)
                    if own.any():
                        base = max(0, s - 2 * length)
                        part = data[base : s + SEGMENT + 3 * length]
                        p, q, c = lo[own] - base, hi[own] - base, high[own] - base
                        core = Hasher(part)(c, c - block + 1 + length)
                        found.append((i, lo[own], hi[own], m[own], core, _digests(part, p, q + length)))
                        held += len(p)
                if held > 200_000:
                    yield _emit(batch.columns[:2], found)
                    found, held = [], 0
            yield _emit(batch.columns[:2], found)

    wanted = todo.groupBy(*_KEYS).agg(F.collect_list(F.struct("a", "b", "m")).alias("items"))
    return _with_text(texts, wanted).select(*_KEYS, "bytes", "items").mapInArrow(run, _ITEM)


def _with_text(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    w = wanted.withColumnsRenamed({"r1": "w1", "r2": "w2"})
    return texts.join(w, (F.col("r1") == F.col("w1")) & (F.col("r2") == F.col("w2")))


def _semi(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """The rows whose `on` is among keys(on..., n), n being how many of about `total` rows have it.
    Frequent keys come by broadcast, so none of them fills a task; their number is below HOT."""
    often = max(1000, total // HOT)
    named = keys.select("n", *[F.col(c).alias(f"_{c}") for c in on])
    same = [F.col(c) == F.col(f"_{c}") for c in on]
    hot, rest = F.broadcast(named.where(F.col("n") > often)), named.where(F.col("n") <= often)
    return rows.join(hot, same, "left_semi").union(rows.join(hot, same, "left_anti").join(rest, same, "left_semi"))


def _settle(items: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items whose windows are all repeated (r1, r2, a, b); one item of each digest of a core that
    has several of them, one of them met once only: those of at most GROUP digests, and the others."""
    total = items.count()
    classes = cut(items.groupBy("k", "o").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r1", "r2", "a", "b", "m")).alias("one")))
    whole = cut(_semi(items, classes.where("n > 1"), ["k", "o"], total).select(*_KEYS, "a", "b"))
    cores = cut(classes.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("n").alias("least")).where("n > 1 and least = 1").drop("least"))
    few = classes.join(cores.where(F.col("n") <= GROUP).select("k"), "k", "left_semi").select("one.*", "k")
    many = _semi(classes.select("one", "k"), cores.where(F.col("n") > GROUP), ["k"], total).select("one.*", "k")
    return whole, few, many


def _ordered(texts: DataFrame, todo: DataFrame, length: int) -> DataFrame:
    """r1, r2, a, b: runs of window starts of todo's items that are repeated among those of their core."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*held)) or [()] * 6, kinds)], names=["r1", "r2", "a", "n", "k", "own"])

        held, size = [], 0
        for batch in batches:
            for r1, r2, data, items in zip(*[batch.column(c) for c in range(4)]):
                r1, r2, data = r1.as_py(), r2.as_py(), data.as_buffer()
                for a, b, k in zip(*[items.values.field(c).to_pylist() for c in (0, 1, 3)]):
                    held.append((r1, r2, a, b - a + 1, k, data[a : b + length].to_pybytes()))
                    size += b - a + length
                if size > ORDERED:
                    yield out()
                    held, size = [], 0
        yield out()

    def runs(r1, r2, a, n, texts: list[bytes]) -> pa.RecordBatch:
        sizes, n = np.array([len(x) for x in texts], np.int64), np.asarray(n, np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
        hit = repeated_places(np.frombuffer(b"".join(texts), np.uint8), offsets, places, length)
        of = np.searchsorted(offsets, hit, "right") - 1
        first = np.flatnonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(of) > 0)])) if len(hit) else np.zeros(0, np.int64)
        last = np.append(first[1:], len(hit))[: len(first)] - 1
        of, lo, hi = of[first], hit[first], hit[last]
        a = np.asarray(a, np.int64)[of] - offsets[of]
        take = pa.array(of)
        return pa.RecordBatch.from_arrays([pa.array(r1, pa.int64()).take(take), pa.array(r2, pa.int64()).take(take), pa.array((a + lo).astype(np.int32)), pa.array((a + hi).astype(np.int32))], names=["r1", "r2", "a", "b"])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [[] for _ in range(5)], 0, None
        for batch in batches:
            for *row, k, own in zip(*[batch.column(c).to_pylist() for c in range(6)]):
                if size > ORDERED and k != last:
                    yield runs(*held)
                    held, size = [[] for _ in range(5)], 0
                for column, x in zip(held, (*row, own)):
                    column.append(x)
                size, last = size + len(own), k
        if size:
            yield runs(*held)

    wanted = todo.groupBy(*_KEYS).agg(F.collect_list(F.struct("a", "b", "m", "k")).alias("items"))
    dealt = _with_text(texts, wanted).select(*_KEYS, "bytes", "items").mapInArrow(strings, "r1 long, r2 long, a int, n int, k long, own binary")
    return dealt.repartition("k").sortWithinPartitions("k").mapInArrow(order, "r1 long, r2 long, a int, b int")


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data, items = batch.column(1)[i].as_py(), batch.column(2)[i].values
                a, b = (np.asarray(items.field(k), np.int64) for k in range(2))
                order = np.argsort(a, kind="stable")
                a, e = a[order], np.maximum.accumulate(b[order] + length)
                new = np.concatenate([[True], a[1:] > e[:-1]])
                starts, ends = a[new], e[np.concatenate([new[1:], [True]])]
                kept, at = [], 0
                for s, t in zip(starts.tolist(), ends.tolist()):
                    kept.append(data[at:s])
                    at = t
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per input row: <id_col>, n_bytes, n_removed, n_spans, kept_sha256 (and `kept`, the bytes).

    Each byte covered by a `length`-byte string that also starts elsewhere, in any row, goes; all
    copies count alike, overlaps included, judged on the input. Texts are UTF-8 bytes; strings
    never cross rows; null counts as empty; texts shorter than `length` stay whole. Rows that
    repeat both id and text are copies of each other like any. Extra columns are ignored; an empty
    table gives an empty result.
    """
    cut = Cut(docs.sparkSession, "repeats", small=True)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bytes"))
    own = own.select(F.xxhash64(F.col("id"), F.col("bytes")).alias("r1"), F.xxhash64(F.lit(7), F.col("bytes"), F.col("id")).alias("r2"), "id", "bytes")
    items = cut(_all_phrases(own, length))
    again = cut(items.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shared = cut(_semi(items, again, ["k"], items.count()))
    cut.drop(items)
    touched = shared.select(*_KEYS).distinct()
    texts = cut(_with_text(own, touched).select(*_KEYS, "id", "bytes"))
    spans, few, many = _settle(shared, cut)
    spans = spans.union(cut(_ordered(texts, few, length)))
    for block in (max(1, min(BLOCK, length // 4)), 1):
        if many.isEmpty():
            break
        whole, few, many = _settle(cut(_narrower(texts, many, length, block)), cut)
        spans = spans.union(whole)
        if block > 1:  # a single window is its own core: no other digest has it
            spans = spans.union(cut(_ordered(texts, few, length)))
    spans = cut(spans.distinct().groupBy(*_KEYS).agg(F.collect_list(F.struct("a", "b")).alias("items")))
    hit = _with_text(texts, spans).select("id", "bytes", "items")
    kind = docs.schema[id_col].dataType.simpleString()
    hit = hit.mapInArrow(_removed(length), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    w = spans.select(F.col("r1").alias("w1"), F.col("r2").alias("w2"))
    size, digest = F.octet_length("bytes").cast("long"), F.sha2("bytes", 256)
    slim = own.select(*_KEYS, "id", size.alias("n_bytes"), digest.alias("kept_sha256"), *([F.col("bytes").alias("kept")] if with_kept else []))
    clean = slim.join(w, (F.col("r1") == F.col("w1")) & (F.col("r2") == F.col("w2")), "left_anti")
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept]
    clean = clean.withColumn("n_removed", F.lit(0).cast("long")).withColumn("n_spans", F.lit(0).cast("long"))
    return hit.select(*names).union(clean.select(*names)).withColumnRenamed("id", id_col)
