"""Near dedup by the Jaccard similarity of word sets, without a miss.

A text's set is the XXH64 of its runs of five words. Links are found in two rounds. The first joins
what is cheap to find: SimHash fingerprints of the sets meet by ball hashing, as in simhash.py, and
sets that share a band of minima of hash functions meet a few of their bucket, the first of each
part. Fingerprints alone can't do: at a similarity of 4/5 they differ in ten of 64 bits on average.
Bands can't be sure: they miss two sets of 4/5 with a probability of 0.8 ** ROWS taken from one, to
the power of BANDS, 0.002.

The second round leaves none out. All sets are put in one order, shingles that many texts hold last.
Two sets of similarity 4/5 or more share a shingle among the first n // 5 + 1 of each, so texts meet
at these, and all pairs that aren't in one component by then are candidates. At the shingle that two
sets meet at first, at most what follows it can be common to both; and their parities, a bit for each
residue of the hashes, can't differ in more bits than the sets do in hashes. Both rule out only pairs
that aren't similar. The order goes by counters of all shingles, a bounded number that many shingles
share: beyond some hundred million shingles the copies of small groups aren't told from single texts
any more. What the order knows decides on the work to do, never on the pairs found. Every pair of either round is compared whole. Equal sets are one node long before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Cut, fresh, text_of
from .components import connected_components
from .simhash import SEED, fingerprint_links, fold, shingle_hashes

SHINGLE, ROWS, BANDS = 5, 5, 16
#: Sets of a bucket that all of its sets are compared with.
PIVOTS = 8
#: Bits of a shingle's hash that name its counter, and bits of these that name a part of the counters.
_COUNTERS, _PARTS = 24, 8
#: Shingles that are counted together.
_LOOK = 500_000
_TURNS = np.random.default_rng(SEED).integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_set(text: str | None) -> np.ndarray:
    """The distinct hashes, in order; none for a text without words."""
    parts = list(shingle_hashes(text, SHINGLE, SEED))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _node(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def bands(own: np.ndarray) -> np.ndarray:
    """A number for each band; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(len(_TURNS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 8192):
        turned = own[at : at + 8192, None] * _TURNS
        low = np.minimum(low, (turned ^ (turned >> np.uint64(31))).min(0))
    held = np.arange(BANDS, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        held = (held ^ row) * _MIX
        held ^= held >> np.uint64(29)
    return held.view(np.int64)


def parity(own: np.ndarray) -> bytes:
    """A bit for each residue, of at least as many as there are hashes: whether an odd number has it."""
    bits = max(64, 1 << (len(own) - 1).bit_length()) if len(own) else 64
    counts = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts & 1, bitorder="little").tobytes()


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two parities (bytes) differ; the longer one is folded to the shorter one's residues."""
    x, y = sorted((x, y), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum())


def _counter(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - _COUNTERS)).astype(np.int64)


def _sketches(texts: DataFrame) -> DataFrame:
    """texts(id, text) -> id, mark (of the text), node (of its set), n, fp, odd (its fingerprint and
    parity), keys (of its bands), and rows (part, counts): a task's counters, up to 255 each."""
    names = ["id", "mark", "node", "n", "fp", "odd", "keys", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count() -> None:
            at, n = np.unique(_counter(np.concatenate(held)), return_counts=True)
            counts[at] = np.minimum(counts[at] + n, 255)

        held, size, counts = [], 0, np.zeros(1 << _COUNTERS, np.uint8)
        for batch in batches:
            own, none = [], [pa.nulls(batch.num_rows, k) for k in kinds[7:]]
            for x in batch.column(2):
                own.append(word_set(x.as_py()))
                held.append(own[-1])
                size += len(own[-1])
                if size >= _LOOK:
                    count()
                    held, size = [], 0
            keys = [bands(x) for x in own]
            ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            fps = pa.array(np.array([fold([x]) for x in own], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(_node, own)), pa.int64()), pa.array(list(map(len, own)), pa.int32()), fps, pa.array(list(map(parity, own)), pa.binary()), lists, *none], names=names)
        if held:
            count()
        parts = [(i, zlib.compress(x.tobytes(), 1)) for i, x in enumerate(counts.reshape(1 << _PARTS, -1)) if x.any()]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(parts), k) for k in kinds[:7]), pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=names)

    return texts.select("id", F.xxhash64(text_of()).alias("mark"), "text").mapInArrow(run, "id long, mark long, node long, n int, fp long, odd binary, keys array<long>, part int, counts binary")


def _levels(counts: DataFrame) -> np.ndarray:
    """(part, counts) of all tasks -> a byte for each counter, higher for higher sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for part, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(own), np.uint8)
                sums[part] = sums.get(part, 0) + own.astype(np.int64)
        made = [np.minimum(np.round(12 * np.log2(1 + x)), 255).astype(np.uint8).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(made, pa.binary())], names=["part", "levels"])

    out = np.zeros((1 << _PARTS, 1 << (_COUNTERS - _PARTS)), np.uint8)
    for r in counts.repartition("part").mapInArrow(run, "part int, levels binary").collect():  # as many bytes as counters
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def _starts(texts: DataFrame, levels: np.ndarray) -> DataFrame:
    """texts(id, text) -> (key, node, n, at): the first n // 5 + 1 shingles of each set of n, by the
    levels of their counters and then by hash."""
    shared = texts.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            out = [(np.zeros(0, np.int64), 0, 0)]
            for x in batch.column(0):
                own = word_set(x.as_py())
                if len(own) < 5:  # similar to equal sets only
                    continue
                first = own[np.argsort(levels[_counter(own)], kind="stable")[: len(own) // 5 + 1]]
                out.append((first.view(np.int64), _node(own), len(own)))
            each = [len(f) for f, *_ in out]
            cols = [np.concatenate([f for f, *_ in out]), np.repeat([x for _, x, _ in out], each), np.repeat([n for *_, n in out], each), np.concatenate([np.arange(n) for n in each])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, (np.int64, np.int64, np.int32, np.int32))], names=["key", "node", "n", "at"])

    return texts.select("text").mapInArrow(run, "key long, node long, n int, at int")


def _alike(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can have a similarity of 4/5."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def _possible(n: Column, at: Column, m: Column, to: Column) -> Column:
    """Whether sets of n and m that first meet at these places can have a similarity of 4/5."""
    return 9 * F.least(n - at, m - to).cast("long") >= 4 * (n + m).cast("long")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, cut: Cut) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 4/5 or more."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("one")).select("one.*")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [word_set(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["node", "own"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    marked = texts.select("id", F.xxhash64(text_of()).alias("mark"), "text")
    w = wanted.select(F.col("id").alias("wid"), F.col("mark").alias("wmark"))
    held = marked.join(w, F.col("id").eqNullSafe(F.col("wid")) & (F.col("mark") == F.col("wmark")), "left_semi").select("text").mapInArrow(sets, "node long, own binary")
    held = cut(held.groupBy("node").agg(F.first("own").alias("own")))
    of = lambda c: held.select(F.col("node").alias(c), F.col("own").alias(f"own_{c}"))
    return cut(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "own_a", "own_b").mapInArrow(similar, "a long, b long"))


def _balls(sets: DataFrame, cut: Cut) -> DataFrame:
    """Pairs (a, b) of nodes that connect all whose fingerprints differ in RADIUS bits at most."""
    c = F.col
    firsts = cut(sets.where("n > 0").groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")))
    same = sets.select("node", c("fp").alias("own")).join(firsts, c("own") == c("fp")).where(c("node") != c("first.node")).select(c("node").alias("a"), c("first.node").alias("b"))
    of = lambda x: firsts.select(c("fp").alias(f"fp_{x}"), c("first.node").alias(f"node_{x}"), c("first.n").alias(f"n_{x}"))
    near = fingerprint_links(firsts.select("fp")).join(of("a"), c("a") == c("fp_a")).join(of("b"), c("b") == c("fp_b"))
    return same.union(near.where(_alike(c("n_a"), c("n_b"))).select(c("node_a").alias("a"), c("node_b").alias("b")))


def _buckets(sets: DataFrame, cut: Cut) -> DataFrame:
    """Pairs (a, b) of nodes that share a band, one of them the first of a part of the bucket."""
    c = F.col
    rows = sets.select("node", "n", F.explode("keys").alias("key"))
    each = rows.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("part")).agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("k"))
    pivots = each.groupBy("key").agg(F.collect_list("first").alias("pivots"), F.sum("k").alias("k")).where("k > 1").drop("k")  # PIVOTS at most
    met = rows.join(pivots, "key").select("node", "n", F.explode("pivots").alias("p"))
    return met.where((c("node") != c("p.node")) & _alike(c("n"), c("p.n"))).select(c("node").alias("a"), c("p.node").alias("b"))


def _apart(texts: DataFrame, levels: np.ndarray, roots: DataFrame, cut: Cut) -> DataFrame:
    """The pairs (a, b) of nodes with different roots (node, root; others are their own) that may be
    similar; no such pair that is similar is left out."""
    c = F.col
    rows = cut(_starts(texts, levels))
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high").select("key")
    met = rows.join(shared, "key", "left_semi").distinct()
    met = cut(met.join(roots, c("node") == c("own"), "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("root")))
    mixed = met.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = cut(met.join(mixed, "key", "left_semi"))
    cut.drop(rows, met)
    x, y = left.alias("x"), left.alias("y")
    may = (c("x.key") == c("y.key")) & (c("x.node") < c("y.node")) & (c("x.root") != c("y.root")) & _possible(c("x.n"), c("x.at"), c("y.n"), c("y.at"))
    return x.join(y.hint("merge"), may).select(c("x.node").alias("a"), c("y.node").alias("b")).distinct()


def _close(pairs: DataFrame, sets: DataFrame, cut: Cut) -> DataFrame:
    """The pairs (a, b) whose parities don't differ in more bits than similar sets of their sizes do in hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = [[np.frombuffer(v.as_buffer(), np.uint8) for v in batch.column(i)] for i in (2, 3)]
            bits = np.array([differing(x, y) for x, y in zip(*odd)], np.int64)
            keep = 9 * bits <= np.asarray(batch.column(4), np.int64) + np.asarray(batch.column(5), np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    of = lambda x: sets.select(F.col("node").alias(x), F.col("odd").alias(f"odd_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "odd_a", "odd_b", "n_a", "n_b")
    return cut(both.mapInArrow(run, "a long, b long"))


def similar_links(texts: DataFrame, cut: Cut) -> tuple[DataFrame, DataFrame]:
    """texts(id, text) -> nodes(id, mark, node), one row a text, and links (a, b) of similar nodes
    that connect the same ones as all pairs of a similarity of 4/5 or more would."""
    made = cut(_sketches(texts))
    rows = made.where("node is not null")
    nodes = rows.select("id", "mark", "node")
    sets = cut(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "fp", "odd", "keys")]))
    found = _verified(_balls(sets, cut).union(_buckets(sets, cut)), nodes, texts, cut)
    roots = cut(connected_components(found, cut).withColumnRenamed("node", "own"))
    rest = _apart(texts, _levels(made.where("part is not null").select("part", "counts")), roots, cut)
    return nodes, found.union(_verified(_close(rest, sets, cut), nodes, texts, cut))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of similar texts, the one with its smallest id; their
    columns are kept.

    Texts are similar if the Jaccard similarity of their sets of five words is 0.8 or more. Words
    are those of the fingerprints; a text of fewer than five is one shingle, and texts without
    words, nulls among them, are similar to each other. Of rows that repeat the smallest id, one
    stays; a component without any id keeps one row. An empty table gives an empty one.
    """
    cut = Cut(docs.sparkSession, "similar")
    nodes, links = similar_links(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), cut)
    roots = connected_components(links, cut).withColumnRenamed("node", "own")
    rooted = nodes.join(roots, F.col("node") == F.col("own"), "left").select("id", "mark", F.coalesce("root", "node").alias("root"))
    stays = cut(rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "mark")).alias("one")).select("one.id", "one.mark"))
    m, i = fresh(docs, "mark_", "id_")
    marked = docs.withColumn(m, F.xxhash64(text_of(text_col))).withColumn(i, F.col(id_col).cast("long"))
    stay = marked.join(stays.withColumnsRenamed({"id": "_kid", "mark": "_kmark"}).hint("shuffle_hash"), (F.col(m) == F.col("_kmark")) & F.col(i).eqNullSafe(F.col("_kid")), "left_semi")
    if not nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        stay = stay.dropDuplicates([m, i])
    return stay.drop(m, i)
