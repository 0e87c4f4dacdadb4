"""Exact dedup: a minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt into shards by their leading bytes. Each shard gets a
minimal perfect hash whose slots hold the whole digest and the locator (largest id, row count) of
its text. Arriving digests, grouped beforehand, look their slot up and compare all 32 bytes; a
match joins the slot's group, anything else is grouped among itself. A shard holds about
SHARD digests whatever the corpus, so a task's memory doesn't grow with it; a text that fills a
third of all rows is one row by then.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, fresh, text_of

SHARD = 8192
_MIX = 0x9E3779B97F4A7C15


class PerfectHash:
    """Levels of bit arrays: keys alone at their place stay, the rest goes one level down.

    ``slots`` numbers the set bits, so n keys get the slots 0..n-1. A key that wasn't built in gets
    any slot or -1; the caller compares what the slot holds.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.base = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.rank = [np.cumsum(x) - x for x in levels]

    @staticmethod
    def _place(words: np.ndarray, level: int, size: int) -> np.ndarray:
        x = words[:, level % 4] ^ np.uint64((level + 1) * _MIX % (1 << 64))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        levels, rest = [], words
        while len(rest):
            size = max(8, int(gamma * len(rest)))
            at = cls._place(rest, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            rest = rest[~alone[at]]
            if len(levels) > 200:
                raise ValueError("the keys aren't distinct")
        return cls(levels)

    def slots(self, words: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(words[open_], level, len(bits))
            hit = bits[at] == 1
            out[open_[hit]] = self.base[level] + self.rank[level][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return sizes.tobytes() + b"".join(np.packbits(x.astype(bool)).tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes, at, levels = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
        for size in map(int, sizes):
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(np.int64))
            at += width
        return cls(levels)


def _words(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 4)


INDEX = "shard int, n long, hash binary, digests binary, ids binary, has_id binary, counts binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    words = _words(pdf["digest"])
    mph = PerfectHash.build(words)
    order = np.empty(len(words), np.int64)
    order[mph.slots(words)] = np.arange(len(words))
    ids = pdf["max_id"].to_numpy(dtype="object")[order]
    has = np.array([x is not None and x == x for x in ids], bool)
    locators = np.array([int(x) if h else 0 for x, h in zip(ids, has)], np.int64)
    return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "n": len(words), "hash": mph.dump(), "digests": words[order].tobytes(), "ids": locators.tobytes(), "has_id": has.tobytes(), "counts": pdf["n"].to_numpy(np.int64)[order].tobytes()}])


def build_index(groups: DataFrame) -> DataFrame:
    """groups(digest, max_id, n, shard), one row a digest -> one row a shard, see INDEX."""
    return groups.groupBy("shard").applyInPandas(_build, INDEX)


def _probe(_, new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Groups of one shard: the slots with what arrived for them, then the digests they lack."""
    # pandas holds long columns with nulls as floats, which lose digits; ids come as strings of them
    made = []
    digests = list(new["digest"]) if len(new) else []
    n_new = new["n"].to_numpy(np.int64) if len(new) else np.zeros(0, np.int64)
    ids = [int(x) if isinstance(x, str) else None for x in new["max_id"]] if len(new) else []
    member = np.zeros(len(digests), bool)
    if len(index):
        row = index.iloc[0]
        held = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        keep = [int(x) if h else None for x, h in zip(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["has_id"], bool))]
        total = np.frombuffer(row["counts"], np.int64).copy()
        if digests:
            words = _words(digests)
            slots = PerfectHash.load(row["hash"]).slots(words)
            member = (slots >= 0) & (held[np.maximum(slots, 0)] == words).all(axis=1)
            for i in np.flatnonzero(member):
                s = slots[i]
                total[s] += n_new[i]
                if ids[i] is not None and (keep[s] is None or ids[i] > keep[s]):
                    keep[s] = ids[i]
        raw = row["digests"]
        made += [(raw[32 * i : 32 * i + 32], keep[i], int(total[i])) for i in range(len(held))]
    made += [(digests[i], ids[i], int(n_new[i])) for i in np.flatnonzero(~member)]
    return pd.DataFrame({"digest": [x[0] for x in made], "keep_id": pd.array([x[1] for x in made], "Int64"), "group_size": [x[2] for x in made]})


def digest_groups(rows: DataFrame, is_history, cut: Cut) -> DataFrame:
    """rows(id, digest) -> digest, keep_id (largest id), group_size. is_history: which rows are the history."""
    dealt = rows.withColumn("old", F.coalesce(is_history, F.lit(False)))
    held = cut(dealt.groupBy("digest", "old").agg(F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n")))
    shards = max(1, -(-held.count() // (2 * SHARD)))
    shard = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(shards)).cast("int")
    held = held.withColumn("shard", shard)
    index = cut(build_index(held.where("old").drop("old")))
    new = held.where(~F.col("old")).drop("old").withColumn("max_id", F.col("max_id").cast("string"))
    return new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe, "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", is_history=None) -> DataFrame:
    """One row per input row: <id_col>, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the largest id
    stays; null ids never win against others, and rows that repeat both id and text share their
    flags. Extra columns are ignored. An empty table gives an empty result. is_history (a Column
    over id and digest): the rows whose digests are indexed; by default a fixed half by hash of
    the id.
    """
    cut = Cut(docs.sparkSession, "exact")
    digest = F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"))
    history = F.pmod(F.xxhash64("id"), F.lit(2)) == 0 if is_history is None else is_history
    groups = cut(digest_groups(rows, history, cut))
    out = rows.join(groups, "digest")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all rows but one of each group of equal texts; their columns are kept.

    The row with the largest id stays; of rows that repeat id and text, any one. Null texts count as
    empty; an empty table gives an empty one.
    """
    cut = Cut(docs.sparkSession, "exact")
    d, i, g, k = fresh(docs, "digest_", "id_", "gdigest_", "keep_id_")
    marked = docs.withColumn(d, F.unhex(F.sha2(text_of(text_col).cast("binary"), 256))).withColumn(i, F.col(id_col).cast("long"))
    rows = marked.select(F.col(i).alias("id"), F.col(d).alias("digest"))
    groups = digest_groups(rows, F.pmod(F.xxhash64("id"), F.lit(2)) == 0, cut)
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = cut(groups.select(F.col("digest").alias(g), named("keep_id").alias(k)))
    # keyed by digest and id together, the hot text's many rows spread over the join's tasks
    stay = marked.withColumn(i, named(i)).join(groups.hint("shuffle_hash"), (F.col(d) == F.col(g)) & (F.col(i) == F.col(k)), "left_semi")
    if not rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # ids alone, no texts
        stay = stay.dropDuplicates([d, i])
    return stay.drop(d, i)
