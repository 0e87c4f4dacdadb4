"""LM scoring by a class-based n-gram model.

P(word | word before) = P(class | class before) * P(word | class), mixed with the unigram
distribution. Classes come from exchange clustering in batches: units are the MOST_OWN most
frequent words, and below those one unit per suffix bucket, so that every word, seen or not, has a
unit without any table of all words. How often unit follows unit is counted once over the whole
training corpus, a table of units by units at most. Each pass moves half of the units that another
class suits better, at random; if that doesn't raise the likelihood of the corpus' class bigrams,
half as many are tried. Passes go on until the likelihood rests. Then every word without a unit of
its own is moved by itself, from its bucket's class to the one that suits its own neighbours; of
these too as many move as raise the likelihood. Only words that training never met keep the class
of their bucket.

Counts and classes of all words stay a table. Frequent words are looked up in a part of it of
bounded size; the rest of a text's words join it, and a text goes on as its words' classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut

MOST_OWN, SUFFIXES, CLASSES = 4096, 1024, 32
#: The clustering rests when a pass raises the log likelihood by less than this share of it.
REST = 2e-4
#: Unit pairs that a worker holds before it passes them on.
HELD_PAIRS = 3_000_000
#: The most frequent words, whose counts every worker holds; all other words are joined.
NEAR = 100_000
#: Share of the class model in the mixture.
SHARE = 0.9
#: Tokens that are counted together.
BATCH = 1_500_000


def is_held_out(doc_id: str) -> bool:
    return zlib.crc32(doc_id.encode()) % 5 == 1


def _tokens(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words as numbers into a list of distinct words, and where each text's words start (one more
    entry than texts). A-Z are lower-cased; words are parted by ASCII white space."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = lists.flatten(), np.asarray(lists.offsets, np.int64)
    ends = ends - ends[0]
    real = np.asarray(pc.binary_length(words)) > 0  # white space at a text's ends parts empty words
    if not real.all():
        words, ends = words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends]
    made = words.dictionary_encode()
    return np.asarray(made.indices, np.int64), made.dictionary.cast(pa.binary()).to_pylist(), ends


def _slices(batch: pa.RecordBatch, column: int, limit: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


def word_counts(training: DataFrame) -> DataFrame:
    """training(text) -> w, n: how often each word occurs; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            for part in _slices(batch, 0):
                index, words, _ = _tokens(part.column(0))
                for w, n in zip(words, np.bincount(index, minlength=len(words)).tolist()):
                    held[w] = held.get(w, 0) + n
                if len(held) > 400_000:
                    yield out(held)
                    held = {}
        yield out(held)

    def out(held: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "n"])

    return training.select("text").mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))


class Units:
    """Which unit a word belongs to. The last unit ends a text."""

    def __init__(self, own: list[bytes], suffixes: int = SUFFIXES):
        self.own, self.suffixes = {w: i for i, w in enumerate(own)}, suffixes
        self.end = len(own) + suffixes

    def of(self, word: bytes) -> int:
        unit = self.own.get(word)
        if unit is None:
            unit = len(self.own) + zlib.crc32(word.rstrip(b".,;:!?\"')")[-3:]) % self.suffixes
        return unit


def _stream(index: np.ndarray, per_word: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Values of the words with `end` before the first text and after each one."""
    return np.concatenate([[end], np.insert(per_word[index], starts[1:], end)])


def unit_pairs(training: DataFrame, units: Units) -> DataFrame:
    """training(text) -> cell, n: how often unit follows unit; cell is before * (units.end + 1) + after."""

    def merged(held: list) -> tuple[np.ndarray, np.ndarray]:
        cells = np.concatenate([c for c, _ in held])
        order = np.argsort(cells, kind="stable")
        cells, n = cells[order], np.concatenate([n for _, n in held])[order]
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else np.zeros(0, np.int64)
        return cells[first], np.add.reduceat(n, first) if len(first) else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1].astype(np.int64))], names=["cell", "n"])
        for batch in batches:
            for part in _slices(batch, 0):
                index, words, starts = _tokens(part.column(0))
                u = _stream(index, np.array([units.of(w) for w in words], np.int64), starts, units.end)
                held.append(np.unique((u[:-1] * (units.end + 1) + u[1:]).astype(np.int32), return_counts=True))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > HELD_PAIRS // 2:
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(merged(held))

    return training.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def context_counts(follows: DataFrame, units: Units, classes: np.ndarray) -> np.ndarray:
    """[unit, side, class]: how often the unit stands before (0) and after (1) the class."""
    kinds, size = int(classes.max()) + 1, units.end + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size * 2 * kinds)
        for batch in batches:
            cell, n = np.asarray(batch.column(0), np.int64), np.asarray(batch.column(1), np.float64)
            before, after = cell // size, cell % size
            held += np.bincount(before * (2 * kinds) + classes[after], n, len(held))
            held += np.bincount(after * (2 * kinds) + kinds + classes[before], n, len(held))
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(held[cells].astype(np.int64))], names=["cell", "n"])

    rows = follows.select("cell", "n").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * 2 * kinds, np.int64)  # at most so many rows come to the driver
    out[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out.reshape(-1, 2, kinds)


def _clusters(x: np.ndarray, weight: np.ndarray, kinds: int) -> np.ndarray:
    """First classes: units with alike neighbours together, by a few rounds of means."""
    x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
    heavy = np.argsort(-weight, kind="stable")
    centres = [x[heavy[0]]]
    for _ in range(kinds - 1):  # each next centre: frequent and far from the centres so far
        far = np.min([((x - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(x[int((far * np.sqrt(weight)).argmax())])
    centres = np.array(centres)
    for _ in range(12):
        at = (x @ centres.T * 2 - (centres**2).sum(1)).argmax(1)
        for k in range(kinds):
            own = at == k
            if weight[own].sum() > 0:
                centres[k] = np.average(x[own], axis=0, weights=weight[own])
    return at


def _class_pairs(contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """How often class follows class [before, after]."""
    pairs = np.zeros((contexts.shape[2], contexts.shape[2]))
    np.add.at(pairs, classes, contexts[:, 0])
    return pairs


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the corpus' class bigrams, but for what no classes change."""
    entropy = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    return entropy(pairs) - entropy(pairs.sum(0)) - entropy(pairs.sum(1))


def exchange(contexts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For each unit the class under which its neighbours are likeliest; the last class is the end's alone."""
    kinds, pairs = contexts.shape[2], _class_pairs(contexts, classes)
    left, right = pairs.sum(1), pairs.sum(0)
    follow = np.log((pairs + 0.1) / (left[:, None] + 0.1 * kinds))
    lead = np.log((pairs + 0.1) / (right[None] + 0.1 * kinds))  # class before, given the one after
    # P(class | one before) * P(unit | class) is P(one before | class) but for what no class changes
    gain = contexts[:, 0] @ follow.T + contexts[:, 1] @ lead
    return np.append(gain[:-1, :-1].argmax(1), kinds - 1)


def learn_classes(follows: DataFrame, units: Units, kinds: int = CLASSES, rest: float = REST) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each unit, how often class follows class, and the likelihood after each pass."""
    first = np.minimum(np.arange(units.end + 1), kinds - 2)
    first[-1] = kinds - 1
    contexts = context_counts(follows, units, first)
    flat = contexts[:-1].reshape(units.end, -1).astype(float)
    classes = np.append(_clusters(flat, flat.sum(1) / 2, kinds - 1), kinds - 1)
    contexts, dice = context_counts(follows, units, classes), np.random.default_rng(1)
    passes = [likelihood(_class_pairs(contexts, classes))]
    while True:
        better, share = exchange(contexts, classes), 0.5
        while share > 0.05:
            new = np.where(dice.random(len(classes)) < share, better, classes)
            found = context_counts(follows, units, new)
            if (value := likelihood(_class_pairs(found, new))) > passes[-1]:
                break
            share /= 2
        else:  # no move helps
            break
        classes, contexts, passes = new, found, [*passes, value]
        if passes[-1] - passes[-2] < rest * abs(passes[-1]):
            break
    return classes, _class_pairs(contexts, classes), passes


def _frequent(counts: DataFrame, most: int) -> list:
    """The most frequent words, at most `most`, by count and then bytes. Of the words of the last
    step of counts that doesn't fit as a whole, those whose hashes are lowest are taken. Only these
    rows are sent to the driver, and two histograms before."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["step"]: r["k"] for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k")).collect()}
    held, wanted = 0, F.lit(False)
    for s in sorted(sizes, reverse=True):
        if held + sizes[s] <= most:
            held, wanted = held + sizes[s], step >= s
            continue
        parts = max(1, min(4096, sizes[s] // 8))
        part = F.pmod(F.xxhash64("w"), F.lit(parts)).cast("int")
        each = {r["part"]: r["k"] for r in counts.where(step == s).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("k")).collect()}
        last = -1
        while last + 1 < parts and held + each.get(last + 1, 0) <= most:
            last += 1
            held += each.get(last, 0)
        wanted = wanted | ((step == s) & (part <= last))
        break
    return sorted(counts.where(wanted).collect(), key=lambda r: (-r["n"], bytes(r["w"])))


@dataclass
class Model:
    """P(word | before) = (c + 0.5) * factor[class before, class]; the end is a word of its own."""

    units: Units
    classes: np.ndarray
    factor: np.ndarray
    tokens: int
    kinds: int  # distinct tokens


def _model(units: Units, classes: np.ndarray, pairs: np.ndarray, sizes: np.ndarray, types: np.ndarray, share: float) -> Model:
    """sizes, types: tokens and distinct words of each class, the end included."""
    tokens, kinds = int(sizes.sum()), int(types.sum())
    whole = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * len(sizes))
    follow = (pairs + 50 * whole) / (pairs.sum(1, keepdims=True) + 50)  # smoothed by the classes' own shares
    # one unseen word a class, except the end's, which has one word only
    room = sizes + 0.5 * (types + 1)
    room[-1] = sizes[-1] + 0.5 * max(1, types[-1])
    factor = share * follow / room + (1 - share) / (tokens + 0.5 * (kinds + len(sizes) - 1))
    return Model(units, classes, factor, tokens, kinds)


def _own_classes(training: DataFrame, units: Units, classes: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """training(text) -> ow, oc: for each word without a unit of its own, the class under which its
    neighbours are likeliest; theirs are those of their units."""
    kinds = pairs.shape[0]
    follow = np.log((pairs + 0.1) / (pairs.sum(1)[:, None] + 0.1 * kinds))
    lead = np.log((pairs + 0.1) / (pairs.sum(0)[None] + 0.1 * kinds))
    gains = (lead[:, None, :] + follow.T[None]).reshape(kinds * kinds, kinds)[:, :-1]  # [before, after], class; the end's is its alone
    gains = np.round(gains * (1 << 24)).astype(np.int64)  # sums don't hang on the rows' order

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 0):
                index, words, starts = _tokens(part.column(0))
                u = np.array([units.of(w) for w in words], np.int64)
                c = _stream(index, classes[u], starts, int(classes[units.end])).astype(np.int64)
                at = np.arange(len(index)) + np.repeat(np.arange(1, len(starts)), np.diff(starts))  # places of the words in c
                other = (u >= len(units.own))[index]
                own = np.sort(index[other] * (kinds * kinds) + c[at[other] - 1] * kinds + c[at[other] + 1])
                word, cell = own // (kinds * kinds), (own % (kinds * kinds)).astype(np.int16)
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else np.zeros(0, np.int64)
                ends = np.append(first, len(word)).astype(np.int32) * 2
                cells = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(cell.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).take(pa.array(word[first])), cells], names=["w", "cells"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda w, sums: pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(sums.argmax(1).astype(np.int32))], names=["ow", "oc"])
        last, rest = None, np.zeros(kinds - 1, np.int64)  # the word that the next rows may go on with
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                words, blobs = (batch.column(i).slice(at, 5000).to_pylist() for i in (0, 1))
                sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 2
                starts = np.cumsum(sizes) - sizes
                cells = np.frombuffer(b"".join(blobs), np.int16)
                new = [0, *(i for i in range(1, len(words)) if words[i] != words[i - 1])]
                sums = np.empty((len(new), kinds - 1), np.int64)
                stops = np.append(starts[new[1:]], len(cells))
                for a in range(0, len(new), 500):  # a part of the gains at a time
                    lo, hi = int(starts[new[a]]), int(stops[min(a + 500, len(new)) - 1])
                    sums[a : a + 500] = np.add.reduceat(gains[cells[lo:hi]], starts[new[a : a + 500]] - lo, axis=0)
                if words[0] == last:
                    sums[0] += rest
                elif last is not None:
                    yield out([last], rest[None])
                yield out([words[i] for i in new[:-1]], sums[:-1])
                last, rest = words[-1], sums[-1]
        if last is not None:
            yield out([last], rest[None])

    rows = training.select("text").mapInArrow(met, "w binary, cells binary")
    return rows.repartition("w").sortWithinPartitions("w").mapInArrow(best, "ow binary, oc int")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """One row per input row: <id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose crc32(id as text) mod 5 is not 1 are learned from; a null id counts as the text
    "null". Null texts are empty: one token, the end. Repeated rows count and score each; of words
    that are equally frequent those whose hashes are lowest have units of their own; extra columns
    are ignored; an empty table gives an empty result. Without training rows every word is
    unknown and all probabilities are those of the smoothing alone.
    """
    cut = Cut(docs.sparkSession, "lm", small=True)
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % 5 == 1
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held_out"))
    training = own.where("not held_out")
    ends = training.count()
    counts = cut(word_counts(training))
    top = _frequent(counts, max(near, MOST_OWN))
    units = Units([bytes(r["w"]) for r in top[:MOST_OWN]])
    follows = cut(unit_pairs(training, units))
    classes, pairs, _ = learn_classes(follows, units)

    def by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = classes[np.array([units.of(w) for w in batch.column(0).to_pylist()], np.int64)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c.astype(np.int32))], names=["w", "n", "c"])

    words = cut(counts.select("w", "n").mapInArrow(by_unit, "w binary, n long, c int"))
    made = None
    if counts.count() > len(units.own):
        others, share = cut(_own_classes(training, units, classes, pairs)), 1.0
        while share > 0.05:
            moves = F.pmod(F.xxhash64("w"), F.lit(1024)) < int(1024 * share)
            moved = words.join(others, F.col("w") == F.col("ow"), "left").select("w", "n", F.when(moves, F.coalesce("oc", "c")).otherwise(F.col("c")).alias("c"))
            moved = cut(moved)
            tried = cut(_classed(own, moved, units, classes, [r["w"] for r in top[:near]], ends, cut))
            found = _pairs_of(tried, pairs.shape[0])
            if likelihood(found) > likelihood(pairs):
                words, made, pairs = moved, tried, found
                break
            cut.drop(tried, moved)
            share /= 2
    if made is None:  # no word moves; texts as the classes of their words' units
        made = cut(_classed(own, words, units, classes, [r["w"] for r in top[:near]], ends, cut))
    sizes, types = np.zeros(pairs.shape[0]), np.zeros(pairs.shape[0])
    for r in words.groupBy("c").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():
        sizes[r["c"]], types[r["c"]] = r["n"], r["k"]
    sizes[-1], types[-1] = sizes[-1] + ends, types[-1] + int(ends > 0)
    model = _model(units, classes, pairs, sizes, types, SHARE)
    logs, base = np.log10(model.factor), float(np.log10(model.tokens + 0.5 * (model.kinds + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = [float(logs[c[:-1], c[1:]].sum()) for c in (np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(5))]
            tokens, known = np.asarray(batch.column(2)), np.asarray(batch.column(4))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(step), model.tokens, np.int64)), pa.array(known - tokens * base), pa.array(known + np.array(step, float))], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = made.mapInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return made.withColumnRenamed("id", id_col)


def _pairs_of(made: DataFrame, kinds: int) -> np.ndarray:
    """How often class follows class in the rows of _classed that are learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(kinds * kinds, np.int64)
        for batch in batches:
            for x in batch.column(0):
                c = np.frombuffer(x.as_buffer(), np.uint8).astype(np.int64)
                held += np.bincount(c[:-1] * kinds + c[1:], minlength=len(held))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], names=["cell", "n"])

    out = np.zeros(kinds * kinds)
    for r in made.where("not held_out").select("seq").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(kinds, kinds)


def _classed(own: DataFrame, words: DataFrame, units: Units, classes: np.ndarray, near: list, ends: int, cut: Cut) -> DataFrame:
    """own(id, text, held_out), words(w, n, c) -> id, held_out, n_tokens, n_known, known (the sum of
    log10(n + 0.5)), seq (a byte a token: the end's class, then that of each word and of the end)."""
    # by Arrow: rows of Python objects would start workers of their own on every executor
    nearest = own.sparkSession.createDataFrame(pa.table({"nw": pa.array([bytes(w) for w in near], pa.binary())}))
    rows = words.join(nearest, F.col("w") == F.col("nw"), "left_semi").collect()  # at most len(near)
    table = {bytes(r["w"]): i for i, r in enumerate(rows)}
    of_table = np.array([[*(r["n"] for r in rows), -1], [*(r["c"] for r in rows), -1]], np.int64)  # the last entry: to be joined
    shared = own.sparkSession.sparkContext.broadcast((table, of_table, units, classes, ends))
    last = int(classes[units.end])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of_table, units, classes, ends = shared.value
        for batch in batches:
            for part in _slices(batch, 1, 3_000_000):
                index, words, starts = _tokens(part.column(1))
                each, texts = np.diff(starts), part.num_rows
                found = of_table[:, np.fromiter(map(table.get, words, repeat(-1)), np.int64, len(words))]
                n, c, of = found[0][index], found[1][index].astype(np.int32), np.repeat(np.arange(texts), each)
                sums = lambda x: np.bincount(of, x, texts)
                logs = sums(np.where(n < 0, 0.0, np.log10(np.maximum(found[0], 0) + 0.5)[index])) + np.log10(ends + 0.5)
                far, at, t = np.unique(of[n < 0] * max(1, len(words)) + index[n < 0], return_inverse=True, return_counts=True)
                k = far % max(1, len(words))
                first = np.searchsorted(far, np.arange(texts + 1) * max(1, len(words)))  # where each text's words to be joined start
                j = np.arange(len(far)) - np.repeat(first[:-1], np.diff(first))
                c[n < 0] = -1 - j[at]
                seen, back = np.unique(k, return_inverse=True)
                d = classes[np.array([units.of(words[i]) for i in seen.tolist()], np.int64)][back]
                rest = pa.StructArray.from_arrays([pa.array(j.astype(np.int32)), pa.array(words, pa.binary()).take(pa.array(k)), pa.array(t.astype(np.int32)), pa.array(d.astype(np.int32))], names=["j", "w", "t", "d"])
                rest = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), rest)
                seq = pa.Array.from_buffers(pa.binary(), texts, [None, pa.py_buffer((starts * 4).astype(np.int32).tobytes()), pa.py_buffer(c.tobytes())])
                known = sums(n > 0).astype(np.int64) + int(ends > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(each + 1), pa.array(known), pa.array(logs), seq, rest], names=["id", "held_out", "n_tokens", "n_known", "known", "seq", "rest"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, far in zip(batch.column(5), batch.column(6)):
                c = np.frombuffer(x.as_buffer(), np.int32)
                if far.is_valid and len(far):
                    of = np.zeros(len(far), np.int32)
                    of[np.asarray(far.values.field("j"))] = np.asarray(far.values.field("c"))
                    c = np.where(c < 0, of[np.minimum(-1 - np.minimum(c, -1), len(of) - 1)], c)
                out.append(np.concatenate([[last], c, [last]]).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.binary())], names=["id", "held_out", "n_tokens", "n_known", "known", "seq"])

    kind = own.schema["id"].dataType.simpleString()
    plain = f"id {kind}, held_out boolean, n_tokens long, n_known long, known double, seq binary"
    made = own.select("id", "text", "held_out").mapInArrow(run, plain + ", rest array<struct<j: int, w: binary, t: int, d: int>>")
    made = cut(made.withColumn("row", F.monotonically_increasing_id()))
    rest = made.select("row", F.explode("rest").alias("x")).select("row", "x.*")
    found = rest.join(words.select(F.col("w").alias("cw"), "n", "c"), F.col("w") == F.col("cw"), "left")
    log = F.col("t") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    found = found.groupBy(F.col("row").alias("frow")).agg(F.sum(log).alias("log"), F.sum(F.when(F.col("n") > 0, F.col("t")).otherwise(0)).alias("more"), F.collect_list(F.struct("j", F.coalesce("c", "d").alias("c"))).alias("far"))
    both = made.drop("rest").join(found, F.col("row") == F.col("frow"), "left")
    return both.select("id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), (F.col("known") + F.coalesce("log", F.lit(0.0))).alias("known"), "seq", "far").mapInArrow(whole, plain)
