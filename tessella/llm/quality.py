"""Quality rules learned as a decision list.

Sequential covering on labelled statistics: each rule is grown on two thirds of the rows still
uncovered, one threshold after the other by information gain, then pruned from its end on the other
third; rules are added while they reject precisely enough there. The list is emitted as ordered
Spark conditional expressions over statistics columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: Labelled documents that rules are learned from; those whose ids hash lowest.
SAMPLE = 20_000
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
_SPACE = b" \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
#: Count over count; a statistic of a text without words is zero.
RATIOS = {
    "symbol_share": ("n_symbols", "n_words"), "word_length": ("word_chars", "n_words"), "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"), "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "mark_share": ("n_marks", "n_words"), "distinct_share": ("n_distinct", "n_words"), "n_words": ("n_words", None),
}


def _dropped(data: bytes, these: bytes) -> int:
    return len(data) - len(data.translate(None, these))


def _repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words in windows of `width` words that are found twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        w = h[:n] * np.uint64(1)
        for k in range(1, width):
            w = w * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    ordered = np.sort(w)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(w, twice)).tolist()
    seen: dict[tuple, list[int]] = {}
    for i in at:  # the words themselves decide, not their hashes
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    starts = np.array([i for x in seen.values() if len(x) > 1 for i in x], np.int64)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of COUNTS; null and empty texts have none of anything."""
    data = (text or "").encode()
    words = data.split()
    lines, dup, seen = 0, 0, set()
    for line in data.split(b"\n"):
        if line.strip():
            lines += 1
            if len(line) > 64:
                line = hashlib.blake2b(line, digest_size=16).digest()
            dup += line in seen
            seen.add(line)
    return (
        len(words), len(text or "") - _dropped(data, _SPACE), _dropped(data, b"#*$%&|<>"), dup, _repeated(words), lines,
        _dropped(data, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _dropped(data, b"0123456789"), _dropped(data, b"!?"), len(set(words)),
    )


def with_statistics(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs and a struct column of COUNTS, all of them from one pass over each text."""
    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    arrow = pa.struct([(c, pa.int64()) for c in COUNTS])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(batch.schema.names.index(text_col))]
            cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(COUNTS))]
            made = pa.StructArray.from_arrays(cols, fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(name, kind)]))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # holds above the threshold, else at or below it
    threshold: float

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= (x[c.feature] > c.threshold) == c.above
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int, steps: int) -> Rule:
    inside, rule = np.ones(len(bad), bool), ()
    while len(rule) < most and (bad & inside).any() and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), (~bad & inside).sum()
        best = (1e-9, None)
        for feature in sorted(x):
            v = x[feature]
            cuts = np.unique(np.quantile(v[inside], np.linspace(0, 1, steps)))
            order = np.sort(v[inside & bad]), np.sort(v[inside & ~bad])
            below = [np.searchsorted(o, cuts, "right") for o in order]
            for above in (False, True):
                p, n = (len(o) - b if above else b for o, b in zip(order, below))
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - np.log2(p0 / (p0 + n0))), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    rest = v[inside & (v > cuts[k])]  # halfway to the next value: room on both sides
                    best = (gain[k], Condition(feature, above, float((cuts[k] + rest.min()) / 2 if len(rest) else cuts[k])))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= _holds((best[1],), x, len(bad))
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, dealt: np.ndarray, precision: float = 0.9, most_rules: int = 12, most_conditions: int = 4, least: int = 3) -> list[Rule]:
    """Ordered rules that reject. dealt: an even number for each row, which parts growing and pruning rows.

    A rule is kept if at least `precision` of what it rejects among all uncovered rows, and among the
    pruning ones, is bad, and at least `least` rows are. Rows without labels of both kinds give no rule.
    """
    rules, open_ = [], np.ones(len(bad), bool)
    for _ in range(most_rules):
        growing, pruning = open_ & (dealt % 3 != 0), open_ & (dealt % 3 == 0)
        if (bad & open_).sum() < least:
            break
        part = lambda m: ({k: v[m] for k, v in x.items()}, bad[m])
        rule = _grow(*part(growing), most_conditions, 65)
        if not rule:
            break
        px, pbad = part(pruning)

        def worth(r: Rule) -> float:
            hit = _holds(r, px, len(pbad))
            return ((pbad & hit).sum() - (~pbad & hit).sum() / (1 - precision) * precision) / max(1, len(pbad))

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit, kept = _holds(rule, x, len(bad)) & open_, _holds(rule, px, len(pbad))
        good = lambda h, b: h.sum() >= 1 and (b & h).sum() >= precision * h.sum()
        if (bad & hit).sum() < least or not good(hit, bad) or (kept.any() and not good(kept, pbad)):
            break
        rules.append(rule)
        open_ &= ~hit
    return rules


def feature(stats: str, name: str) -> Column:
    over, under = RATIOS[name]
    value = F.col(stats)[over].cast("double")
    return value if under is None else F.when(F.col(stats)[under] > 0, value / F.col(stats)[under]).otherwise(0.0)


def verdict(rules: list[Rule], stats: str) -> Column:
    """kept, by the first rule that holds; without one, true."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & (feature(stats, c.feature) > c.threshold if c.above else feature(stats, c.feature) <= c.threshold)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def failed(stats: str) -> Column:
    n, again = F.col(stats)["n_words"], F.col(stats)["n_repeat_words"]
    return (n < LEAST_WORDS) | (100 * again > MOST_REPEATED * n)


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> list[Rule]:
    """Rules from the `sample` labelled documents whose ids hash lowest; label 0 is bad. Null ids and
    labels don't count; of several labels of a document the lowest does, and of several texts of one
    id the one with the least statistics."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.min(label_col).alias("y"))
    few = known.orderBy(F.xxhash64("i"), "i").limit(sample).collect()
    if not few:
        return []
    marked = docs.sparkSession.createDataFrame(few, known.schema)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), F.col("id") == F.col("i")).select("id", "y", "text")
    rows = with_statistics(own, "text", "s").select("id", "y", F.xxhash64("id", F.lit(1)).alias("dealt"), *[feature("s", f).alias(f) for f in RATIOS])
    one = rows.groupBy("id").agg(F.min(F.struct("dealt", "y", *RATIOS)).alias("one"))  # a row an id: `sample` at most
    got = one.select("one.*").orderBy("dealt").toPandas()
    x = {f: got[f].to_numpy(float) for f in RATIOS}
    return learn(x, got["y"].to_numpy(float) < 0.5, got["dealt"].to_numpy(np.int64).view(np.uint64) >> np.uint64(3))


def apply_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    Null counts as the empty text, which has no words and fails. Repeated rows repeat; extra columns
    are ignored; an empty table gives an empty result; without labels there is no rule and only
    base_failed rejects.
    """
    own = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", "s").drop("text")
    return own.select(F.col("id").alias(id_col), *[F.col("s")[c].alias(c) for c in COUNTS[:5]], failed("s").alias("base_failed"), (~failed("s") & verdict(rules, "s")).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """docs without the rows that apply_rules rejects; their columns are kept. Null and empty texts
    have too few words and go; an empty table gives an empty one."""
    (s,) = fresh(docs, "stats_")
    return with_statistics(docs, text_col, s).where(~failed(s) & verdict(rules, s)).drop(s)
