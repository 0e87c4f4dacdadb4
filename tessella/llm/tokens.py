"""Public tokenizers over Arrow batches: byte-level BPE both ways, and counts of huge documents.

Tokenizers are built or read on the driver and travel to the workers as one JSON string; workers
never open the vocabulary files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import DataFrame  # noqa: E402
from tokenizers import Regex, Tokenizer, models, pre_tokenizers  # noqa: E402

from .common import runs  # noqa: E402

BYTE_RANKS, WORD_VOCAB = "byte_bpe_50k.tiktoken", "word_bpe_49k.json"
TOKEN_LIMIT = 2048


@lru_cache(1)
def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _halves(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that merge into the token last, by the ranks below its own."""
    parts, own = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
        if rank >= own:
            raise ValueError(f"{token!r} can't be reached by merges")
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


def byte_tokenizer(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """The tokenizer that the ranks define: by each match of the pattern, lowest rank first."""
    table = byte_chars()
    show = lambda token: "".join(table[b] for b in token)
    order = sorted(ranks, key=ranks.get)
    merges = [tuple(map(show, _halves(t, ranks))) for t in order if len(t) > 1]
    made = Tokenizer(models.BPE(vocab={show(t): r for t, r in ranks.items()}, merges=merges))
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def _latin(kind: str) -> str:
    """Character class content: the code points below U+0250 of a general category."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: Anything but Latin text; four controls too, which libraries disagree on as white space.
_FOREIGN = re.compile("[^\0-\x1b\x20-ɏ]")


class Encoder:
    """Encodes texts with a tokenizer, piece by piece, remembering what its model made of a piece.

    Text below U+0250 is cut by the tokenizer's own pattern and each new piece goes to the
    tokenizer's model; the split is the slow part of such text, and most pieces come again. Any
    other text, and what could hold a special token, is left to the tokenizer as a whole.
    `value` turns a list of ids into what is kept of it.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: str, lower: bool, value: Callable[[list[int]], object], most: int = 400_000, longest: int = 64):
        self.tokenizer, self.lower, self.value, self.kept = tokenizer, lower, value, {}
        self.most, self.longest = most, longest  # pieces that are remembered, and their characters at most
        letters, numbers = _latin("L"), _latin("N")
        plain = re.sub(r"\[(\^?)((?:\\s|\\p\{[LN]\})+)\]", lambda m: f"[{m[1]}{m[2].replace(chr(92) + 'p{L}', letters).replace(chr(92) + 'p{N}', numbers)}]", pattern)
        self.pieces = re.compile(plain.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")).findall
        self.shown = str.maketrans({b: c for b, c in enumerate(byte_chars())})

    def _new(self, piece: str):
        made = self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))
        return self.value([t.id for t in made])

    def values(self, text: str) -> list:
        """What is kept of each piece, in order."""
        if not text:
            return []
        plain = text.lower() if self.lower else text
        if _FOREIGN.search(plain) or (self.lower and "<|" in text):
            return [self.value(self.tokenizer.encode(text, add_special_tokens=False).ids)]
        kept, pieces, long = self.kept, self.pieces(plain), {}
        if len(kept) > self.most:
            kept.clear()
        for piece in set(pieces).difference(kept):
            (kept if len(piece) <= self.longest else long)[piece] = self._new(piece)
        return [long[piece] if piece in long else kept[piece] for piece in pieces] if long else [kept[piece] for piece in pieces]


def lower_case_encoder(tokenizer: Tokenizer, value: Callable[[list[int]], object]) -> Encoder | None:
    """An Encoder for a tokenizer that composes, lower-cases and cuts by a pattern; None for any other."""
    spec = json.loads(tokenizer.to_str())
    steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed" and not cuts[1]["add_prefix_space"]
    if not known or not all(x["content"].startswith("<|") for x in spec["added_tokens"]):
        return None
    return Encoder(tokenizer, cuts[0]["pattern"]["Regex"], True, value)


def token_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id, by the reversed byte table."""
    back, vocab = {c: b for b, c in enumerate(byte_chars())}, tokenizer.get_vocab()
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token)
    return out


def offsets(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last code point (exclusive) of tokens of so many bytes each, of a text in UTF-8. A
    character that is split over tokens belongs to each of them."""
    end = np.cumsum(sizes)
    if data.isascii():
        return end - sizes, end
    of = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) - 1  # the code point of each byte
    return of[end - sizes], of[end - 1] + 1


def _broadcast(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, ids, starts, ends (arrays of int: ids and code point offsets).

    Whole texts are encoded without special tokens; null counts as empty, with no token. Repeated
    rows repeat; extra columns are ignored; an empty table gives an empty result.
    """
    ranks, pattern = read_ranks(ranks_path or public_tokenizers.path(BYTE_RANKS)), pattern or public_tokenizers.PATTERN
    spec, names = byte_tokenizer(ranks, pattern).to_str(), [id_col, "ids", "starts", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_str(spec)
        sizes = np.array([len(x) for x in token_bytes(tokenizer)], np.int32)
        encoder = Encoder(tokenizer, pattern, False, lambda ids: np.array(ids, np.int32).tobytes())
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in runs(texts):
                out = []
                for text in texts[a:b]:
                    ids = np.frombuffer(b"".join(encoder.values(text)), np.int32)
                    out.append((ids, *offsets(text.encode(), sizes[ids])))
                lengths = pa.array(np.cumsum([0, *(len(x[0]) for x in out)]).astype(np.int32))
                cols = [pa.ListArray.from_arrays(lengths, pa.array(np.concatenate(c).astype(np.int32))) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *cols], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode(encoded: DataFrame, ranks_path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """encoded(<id_col>, ids) -> <id_col>, bytes: what the ids stand for. A null or empty list gives
    no bytes; extra columns are ignored; an empty table gives an empty result."""
    table = {i: token for token, i in read_ranks(ranks_path or public_tokenizers.path(BYTE_RANKS)).items()}
    shared = _broadcast(encoded, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join([table[i] for i in x.as_py() or ()]) for x in batch.column(1)], pa.binary())], names=[id_col, "bytes"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def byte_round_trip(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, n_tokens, ids_sha256 (decimal ids, space-joined),
    decoded_sha256, offsets_sha256 (all starts, then all ends, as little-endian 32-bit numbers),
    n_split (how often a character goes on in the next token).

    What `encode` and `decode` give, as digests made in one pass: of each piece the encoder keeps
    its ids as text, the bytes they stand for, and these bytes' number by token. Null counts as
    empty, with no token. Repeated rows repeat; extra columns are ignored; an empty table gives an
    empty result.
    """
    ranks, pattern = read_ranks(ranks_path or public_tokenizers.path(BYTE_RANKS)), pattern or public_tokenizers.PATTERN
    spec = byte_tokenizer(ranks, pattern).to_str()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256", "n_split"]
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_str(spec)
        table = token_bytes(tokenizer)
        encoder = Encoder(tokenizer, pattern, False, lambda ids: (" ".join(map(str, ids)).encode(), b"".join([table[i] for i in ids]), np.array([len(table[i]) for i in ids], np.int32).tobytes()))
        for batch in batches:
            out = []
            for x in batch.column(1):
                text = x.as_py() or ""
                made = list(zip(*encoder.values(text))) or [()] * 3
                sizes = np.frombuffer(b"".join(made[2]), np.int32)
                starts, ends = offsets(text.encode(), sizes)
                both = np.concatenate([starts, ends]).astype("<i4")
                out.append((len(sizes), sha(b" ".join(made[0])), sha(b"".join(made[1])), sha(both), int((ends[:-1] > starts[1:]).sum())))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string, n_split long")


# Counts ------------------------------------------------------------------------------------------

#: Characters of a chunk, and that neighbouring chunks share at first. No common place: the share doubles.
CHUNK, OVERLAP = 32_768, 512
#: A chunk's last characters don't count for alignment: what follows could still change their tokens.
_GUARD = 64


def _starts(text: str, base: int, encoding) -> dict[int, int]:
    """Where pieces of the text begin (code points), and the tokens before each."""
    out, last = {}, object()
    for n, (word, (a, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word is None or word != last:  # added tokens belong to no word
            out.setdefault(base + a, n)
        last = word
    return out


@lru_cache(1)
def _joining() -> frozenset[str]:
    """Characters that normalisation may join to what stands before them, without being marks."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(0xA0, 0x2FA20))
    second = {chr(int(p[1], 16)) for p in parts if len(p) == 2 and p[0][0] != "<"}
    return frozenset(second | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


def _stable(text: str, at: int) -> bool:
    """No normalisation reaches across: what follows neither is a mark nor joins what stands before."""
    if not 0 < at < len(text):
        return False
    c = text[at]
    return c < "\x80" or (unicodedata.combining(c) == 0 and c not in _joining() and unicodedata.is_normalized("NFC", c))


def resynchronised_count(tokenizer: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The tokens of a text of any length, from overlapping chunks.

    Two neighbours are spliced where both begin a piece at the same place that normalisation doesn't
    reach across, clear of the left chunk's end. Left of it, the left chunk has seen all that its tokens depend
    on; from a piece's beginning onward, encoding depends on what follows only, so the right chunk
    agrees with the whole text there. Without such a place the overlap is doubled, down to one
    encoding of everything from the left chunk's beginning.
    """
    total, begin, origin = 0, 0, 0
    left = tokenizer.encode(text[:chunk], add_special_tokens=False)
    end = min(chunk, len(text))
    while end < len(text):
        known, share = _starts(text, origin, left), overlap
        while True:
            right_at = max(begin, end - share)
            right_end = min(len(text), right_at + max(chunk, 2 * share))
            right = tokenizer.encode(text[right_at:right_end], add_special_tokens=False)
            if right_at <= begin:  # no place in all of the left chunk: it is encoded anew, longer
                origin, left, end, known = right_at, right, right_end, None
                break
            both = _starts(text, right_at, right)
            place = min((p for p in known.keys() & both.keys() if right_at < p <= end - _GUARD and p > begin and _stable(text, p)), default=None)
            if place is not None:
                total += known[place] - known.get(begin, 0)
                begin, origin, left, end, known = place, right_at, right, right_end, None
                break
            share *= 2
    return total + len(left.ids) - _starts(text, origin, left).get(begin, 0)


def token_counts(docs: DataFrame, vocab_path: str | None = None, limit: int = TOKEN_LIMIT, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are those of encoding each whole text at once, without added special tokens, truncation
    or padding; texts beyond `chunk` characters are counted by overlapping chunks. Null counts as
    empty, with no token. Repeated rows repeat; extra columns are ignored; an empty table gives an
    empty result.
    """
    whole = Tokenizer.from_file(vocab_path or public_tokenizers.path(WORD_VOCAB))
    whole.no_truncation()
    whole.no_padding()
    spec, names = whole.to_str(), [id_col, "n_bytes", "n_tokens", "over_limit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer.from_str(spec)
        encoder = lower_case_encoder(tokenizer, len)
        for batch in batches:
            texts, counts = [x or "" for x in batch.column(1).to_pylist()], []
            for a, b in runs(texts, 500_000):
                small = [x for x in texts[a:b] if len(x) <= chunk]
                made = iter([sum(encoder.values(x)) for x in small] if encoder else [len(e.ids) for e in tokenizer.encode_batch_fast(small, add_special_tokens=False)])
                counts += [next(made) if len(x) <= chunk else resynchronised_count(tokenizer, x, chunk) for x in texts[a:b]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
