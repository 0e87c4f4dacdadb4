"""Best-fit packing by linear grouping.

Only lengths decide how pieces are packed, and there are at most `limit` of them: the plan is made
from the histogram of lengths, whose size doesn't depend on the corpus. Large lengths are parted
into groups of equal cardinality and rounded up to their group's largest; the few sizes left are
packed by the linear programme over configurations (columns made on demand by a knapsack). Whole
multiples of the configurations are filled with actual pieces, which frees what the rounding took;
the rest, large and small, goes best-fit, equal pieces and equal sequences together. The plan says
which ranks of a length go where; pieces are ranked within their length over many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Cut
from .tokens import WORD_VOCAB, Tokenizer, lower_case_encoder

LIMIT, END_ID = 4096, 1
#: Sizes that large lengths are rounded up to; lengths over limit / LARGE are large.
GROUPS, LARGE = 32, 8
#: Pieces of a bucket within which ranks are counted.
BUCKET = 20_000


def _knapsack(sizes: list[int], worth: np.ndarray, limit: int) -> tuple[float, np.ndarray]:
    """The most worth that fits into limit, any number of each size."""
    best, came, s = np.zeros(limit + 1), np.full(limit + 1, -1), np.array(sizes)
    for room in range(int(s.min()), limit + 1):
        fits = np.flatnonzero(s <= room)
        gain = best[room - s[fits]] + worth[fits]
        k = int(gain.argmax())
        if gain[k] > best[room - 1] + 1e-12:
            best[room], came[room] = gain[k], fits[k]
        else:
            best[room] = best[room - 1]
    out, room = np.zeros(len(sizes)), limit
    while room > 0:
        if came[room] < 0 or best[room] <= best[room - 1] + 1e-12:
            room -= 1
        else:
            out[came[room]] += 1
            room -= sizes[came[room]]
    return float(best[limit]), out


def configurations(sizes: list[int], demand: list[int], limit: int, rounds: int = 400) -> list[tuple[np.ndarray, float]]:
    """(how many of each size, how often) that meet the demand with the least sequences, fractional."""
    m = len(sizes)
    basis = np.diag([float(limit // s) for s in sizes])
    need = np.array(demand, float)
    for _ in range(rounds):
        x = np.linalg.solve(basis, need)
        worth = np.linalg.solve(basis.T, np.ones(m))
        value, column = _knapsack(sizes, worth, limit)
        if value <= 1 + 1e-7:
            break
        way = np.linalg.solve(basis, column)
        up = way > 1e-9
        ratio = np.where(up, np.maximum(x, 0) / np.where(up, way, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.solve(basis, need)
    return [(basis[:, j].round().astype(int), float(x[j])) for j in range(m) if x[j] > 1e-9]


class _Bins:
    """Equal sequences counted together, found by the room that is left in them."""

    def __init__(self, limit: int):
        self.limit, self.rooms, self.at = limit, [], {}

    def add(self, n: int, room: int, content: tuple) -> None:
        if n:
            if room not in self.at:
                self.at[room] = []
                insort(self.rooms, room)
            self.at[room].append((n, content))

    def best_fit(self, length: int, n: int) -> None:
        while n:
            i = bisect_left(self.rooms, length)
            room = self.rooms[i] if i < len(self.rooms) else None
            bins, content = self.at[room].pop() if room is not None else (n, ())
            if room is not None and not self.at[room]:
                del self.at[room], self.rooms[i]
            room = self.limit if room is None else room
            each = min(n, room // length)
            used = min(bins, n // each)
            n -= used * each
            self.add(used, room - each * length, (*content, (length, each)))
            if content:
                self.add(bins - used, room, content)


def plan(counts: dict[int, int], limit: int = LIMIT, groups: int = GROUPS, large: int = LARGE) -> list[tuple[int, tuple]]:
    """(how many sequences, ((length, how many in each), ...)) for counts of each length."""
    bins = _Bins(limit)
    bins.add(counts.get(limit, 0), 0, ((limit, 1),))
    left = {k: n for k, n in counts.items() if n and k < limit}
    big = sorted((k for k in left if k * large > limit), reverse=True)
    total, queues, part = sum(left[k] for k in big), [], []
    room = share = -(-total // groups)
    for length in big:  # each group has as many pieces; a frequent length has groups of its own
        n = left[length]
        while n:
            some = min(n, room)
            part.append([length, some])
            n, room = n - some, room - some
            if not room or (not n and length == big[-1]):
                if queues and queues[-1][0][0] == part[0][0]:  # rounded up to the same size
                    queues[-1] += part
                else:
                    queues.append(part)
                part, room = [], share
    # the first group has nothing above it to stand for; unless it is one length, best fit places it
    queues = queues[len(queues) > 1 and len(queues[0]) > 1 :]
    if queues:
        for q in queues:
            for k, n in q:
                left[k] -= n
        for column, times in configurations([q[0][0] for q in queues], [sum(n for _, n in q) for q in queues], limit):
            times = int(times + 1e-9)
            if not times:
                continue
            slots = [_take(queues[g], times) for g in range(len(queues)) for _ in range(column[g])]
            while times := min((s[-1][1] for s in slots if s), default=0):
                lengths = sorted(s[-1][0] for s in slots if s)
                content = tuple((k, lengths.count(k)) for k in dict.fromkeys(lengths))
                bins.add(times, limit - sum(lengths), content)
                for s in slots:
                    if s:
                        s[-1][1] -= times
                        if not s[-1][1]:
                            s.pop()
        for q in queues:
            for k, n in q:
                left[k] += n
    for length in sorted(left, reverse=True):
        bins.best_fit(length, left[length])
    return [x for room in bins.rooms for x in bins.at[room]]


def _take(queue: list[list[int]], n: int) -> list[list[int]]:
    """n pieces off a group's queue, as [length, how many], to be used from the last."""
    out = []
    while n and queue:
        some = min(n, queue[0][1])
        out.append([queue[0][0], some])
        queue[0][1] -= some
        n -= some
        if not queue[0][1]:
            queue.pop(0)
    return out


def placements(packed: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """For each content of the plan: the ranks of its length from `first` on go, `each` to a
    sequence, to those from `sequence` on, at `offset`; by length, then first."""
    rows, ranks, sequence = [], {}, 0
    for n, content in packed:
        offset = 0
        for length, each in content:
            first = ranks.get(length, 0)
            ranks[length] = first + n * each
            rows.append((length, first, each, sequence, offset))
            offset += length * each
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), cols))


def pieces(docs: DataFrame, vocab_path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids and the end id, cut at the limit."""
    spec = Tokenizer.from_file(vocab_path or public_tokenizers.path(WORD_VOCAB)).to_str()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        packed = lambda ids: np.array(ids, "<u4").tobytes()
        encoder = lower_case_encoder(tokenizer, packed)  # None: a tokenizer of another make
        encode = encoder.values if encoder else lambda x: [packed(tokenizer.encode(x, add_special_tokens=False).ids)]
        for batch in batches:
            own, out = [], []
            for i, x in enumerate(batch.column(1)):
                ids = b"".join([*encode(x.as_py() or ""), end])
                for at in range(0, len(ids), 4 * limit):
                    part = ids[at : at + 4 * limit]
                    own.append(i)
                    out.append((at // (4 * limit), at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def _ranked(parts: DataFrame, total: int) -> DataFrame:
    """parts with `rank_`, the place of each piece among those of its length, from 0.

    Ranks are counted within buckets of a length and shifted by what the buckets before it hold, so
    a length that a third of all pieces have still spreads over all tasks.
    """
    buckets = max(1, -(-total // BUCKET))
    dealt = parts.withColumn("bucket_", F.pmod(F.xxhash64("row_"), F.lit(buckets)))
    held = dealt.groupBy("length", "bucket_").agg(F.count(F.lit(1)).alias("held_"))
    before = Window.partitionBy("length").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select(F.col("length").alias("slength_"), F.col("bucket_").alias("sbucket_"), F.coalesce(F.sum("held_").over(before), F.lit(0)).alias("shift_"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket_").orderBy("row_")) - 1
    ranked = dealt.withColumn("inside_", inside).join(shift, (F.col("length") == F.col("slength_")) & (F.col("bucket_") == F.col("sbucket_")))
    return ranked.withColumn("rank_", F.col("inside_") + F.col("shift_"))


def pack(docs: DataFrame, vocab_path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: <id_col>, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is its end id alone. Repeated rows are packed each; extra columns are
    ignored; an empty table gives an empty result. Which of the pieces of equal length take which
    place follows the order in which they were written.
    """
    cut = Cut(docs.sparkSession, "pack")
    parts = cut(pieces(docs, vocab_path, limit, id_col, text_col).withColumn("row_", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `limit` rows
    at = placements(plan(counts, limit))
    key = (at["length"] << 44) + at["first"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(k), np.int64) for k in (3, 5))
            row = np.searchsorted(key, (length << 44) + rank, "right") - 1
            ahead = rank - at["first"][row]
            sequence = at["sequence"][row] + ahead // at["each"][row]
            offset = at["offset"][row] + ahead % at["each"][row] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    names = [id_col, "piece", "start", "length", "ids_crc32"]
    kind = docs.schema[id_col].dataType.simpleString()
    ranked = _ranked(parts, sum(counts.values())).select(*names, F.col("rank_").cast("long"))
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
