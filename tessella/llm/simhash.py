"""SimHash near-dedup by meet-in-the-middle ball hashing.

Fingerprints within distance 2r share at least one variant within distance r of both. So each
distinct fingerprint emits its whole ball of radius r (65 variants for r = 1), the variants are
shuffled, and fingerprints that meet at a variant are linked. A variant meets at most as many
distinct fingerprints as its own ball holds, so no group is large; within a group each fingerprint
is linked to the one before it, which connects the same fingerprints as all pairs would. Copies
and texts of one fingerprint are one row long before that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Cut, appended, fresh, text_of
from .components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 2
_BLOCK = 4_000_000


def _blocks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a few megabytes of it at a time."""
    at = 0
    while at < len(data):
        end = at + _BLOCK
        if end < len(data):
            while end < len(data) and data[end] not in b" \t\n\v\f\r":
                end += 1
        yield data[at:end].split()
        at = end


def shingle_hashes(text: str | None, shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The shingles' XXH64 in order, by parts; none for a text without words."""
    digest, carry, none = xxhash.xxh64_intdigest, [], True
    for words in _blocks((text or "").encode().lower()):
        words = carry + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[:-1].tolist()]
            yield np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], np.uint64)
            none, carry = False, words[len(words) - shingle + 1 :]
        else:
            carry = words
    if none and carry:
        yield np.array([digest(b" ".join(carry), seed)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, unsigned; bit k is set if over half the shingles' XXH64 have it. No word: zero.

    A-Z are lower-cased; words are parted by space, tab, newline, vertical tab, form feed and
    carriage return. Fewer words than a shingle holds: the whole sequence is the one shingle.
    """
    return fold(shingle_hashes(text, shingle, seed))


def fold(parts: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        for at in range(0, len(hashes), 65536):
            part = hashes[at : at + 65536]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, text_col: str, name: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs and a column: the fingerprint's bits as a signed long."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_col))
            made = np.array([fingerprint(x.as_py(), shingle, seed) for x in texts], np.uint64)
            yield appended(batch, {name: pa.array(made.view(np.int64))})

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def _ball(radius: int) -> list[int]:
    """Masks of at most radius bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fps(fp), distinct -> links (a, b) of fingerprints within radius bits (an even number) that
    connect all such pairs."""
    masks = F.array(*[F.lit(m).cast("long") for m in _ball((radius + 1) // 2)])
    variants = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = variants.withColumn("before", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= radius
    return met.where(F.col("before").isNotNull() & near).select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()


def fingerprint_components(rows: DataFrame, cut: Cut, radius: int = RADIUS) -> DataFrame:
    """rows(id, fp) -> (gfp, component_id), one row a fingerprint; the component's smallest id."""
    if radius % 2:
        raise ValueError("the radius must be even: each side takes half of it")
    return node_components(rows, lambda fps: fingerprint_links(fps, radius), cut)


def node_components(rows: DataFrame, links: Callable[[DataFrame], DataFrame], cut: Cut) -> DataFrame:
    """The same over any links between the values of fp, given these."""
    firsts = cut(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    roots = connected_components(links(firsts.select("fp")), cut)
    rooted = cut(firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id"))
    lowest = cut(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).withColumnRenamed("root", "r"))
    return cut(rooted.join(lowest, F.col("root") == F.col("r")).select(F.col("fp").alias("gfp"), "component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: <id_col>, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest id reachable over links of at most radius differing bits, itself
    included. A null or wordless text has fingerprint zero and links like any other; a null id
    never names a component that has another. Repeated rows repeat. An empty table gives an empty
    result; extra columns are ignored.
    """
    cut = Cut(docs.sparkSession, "simhash")
    rows = cut(with_fingerprint(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text", "fp").select("id", "fp"))
    groups = fingerprint_components(rows, cut, radius)
    return rows.join(groups, F.col("fp") == F.col("gfp")).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component, the one with its smallest id; their columns are kept.

    Of rows that repeat that id, one stays (the smallest fingerprint's); a component without any
    id keeps one row.
    """
    cut = Cut(docs.sparkSession, "simhash")
    ids = F.col(id_col).cast("long")
    rows = cut(with_fingerprint(docs.select(ids.alias("id"), F.col(text_col).alias("text")), "text", "fp").select("id", "fp"))
    return keep_nodes(docs, rows, fingerprint_components(rows, cut, radius), lambda d, name: with_fingerprint(d, text_col, name), id_col, cut)


def keep_nodes(docs: DataFrame, rows: DataFrame, groups: DataFrame, mark: Callable[[DataFrame, str], DataFrame], id_col: str, cut: Cut) -> DataFrame:
    """docs with one row of each of groups(gfp, component_id), given rows(id, fp); mark adds fp to docs."""
    f, i, g, k = fresh(docs, "fp_", "id_", "gfp_", "stay_")
    mine = rows.join(groups, F.col("fp") == F.col("gfp")).where(F.col("id").eqNullSafe(F.col("component_id")))
    best = mine.groupBy("component_id", "id").agg(F.min("fp").alias(g)).where("component_id is not null")
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    # a component without ids is named by its smallest fingerprint, which alone can't link two
    lone = mine.where("component_id is null").groupBy("fp").agg(F.first("id").alias("id")).select("id", F.col("fp").alias(g))
    best = cut(best.select(named("id").alias(k), g).union(lone.select(named("id").alias(k), g)))
    marked = mark(docs, f).withColumn(i, named(id_col))
    stay = marked.join(best, (F.col(f) == F.col(g)) & (F.col(i) == F.col(k)), "left_semi")
    return stay.dropDuplicates([f, i]).drop(f, i)
