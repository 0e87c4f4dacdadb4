"""Secret scans that unwrap encoded layers.

A worklist starts with the text itself. Each layer is scanned, then unwrapped in every way that
applies: percent escapes, Unicode escapes and character references (over the whole layer, each
decoded character mapped to what it was decoded from), base64 runs, and compressed streams inside
those. New layers join the worklist until nothing new appears; a layer seen before at the same
place ends its branch, so self-reproducing streams end too. Spans of inner layers are mapped to
code points of the original text: character by character through escapes, four by four through
base64, and to the whole run through compression.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import io
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4})+|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: Escaped first bytes of a compressed stream, and what follows them without white space.
_BYTES = re.compile(r"(?i)(?:(?:%|\\x)1f(?:%|\\x)8b|(?:(?:%|\\x)78|x)(?:(?:%|\\x)(?:01|5e|9c|da)|\^(?=%|\\x))|(?:(?:%|\\x)42|B)(?:(?:%|\\x)5a|Z)(?:(?:%|\\x)68|h)|(?:%|\\x)fd(?:(?:%|\\x)37|7)|(?:(?:%|\\x)28|\()(?:%|\\x)b5)[\x21-\x7e]+")
_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}\r?\n)+[A-Za-z0-9+/_-]+={0,2}")
#: Characters of an inflated layer that are looked at together, and how many of them again with the next.
_PIECE, _OVERLAP = 4_000_000, 65_536
#: What an encoded run that goes on in the next piece is made of.
_OPEN = re.compile(r"[A-Za-z0-9+/_=\-%\\&#;{}\r\n]*")
#: Base64 digits of either alphabet as those of the first, and what stands between them as nothing.
_DIGITS = str.maketrans("-_", "+/", "\r\n=")
#: How a compressed stream begins: gzip, zlib, bzip2, xz, zstd.
_MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]1AY|\xfd7zXZ\0|\x28\xb5\x2f\xfd")
_UNSOUND = (OSError, ValueError, EOFError, zlib.error, lzma.LZMAError, zstandard.ZstdError)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of each span, by kind leftmost and non-overlapping."""
    low, found = text.lower(), []
    if any(word in low for word in _NAMES):  # the pattern alone is several times slower
        found = [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    return found


@dataclass
class Layer:
    text: str
    starts: np.ndarray | None  # of each character, in the original; None: the original itself
    ends: np.ndarray | None

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))

    def key(self) -> bytes:
        where = b"" if self.starts is None else self.starts.tobytes() + self.ends.tobytes()
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass") + b"\0" + where, digest_size=16).digest()


def _chars(data: bytes, unit: int) -> tuple[str, list[int], list[int]]:
    """Bytes as UTF-8, unsound ones replaced, and where each character's bytes start and end, in units."""
    out, a, b, at = [], [], [], 0
    for ch in data.decode("utf-8", "surrogateescape"):
        n = 1 if 0xDC80 <= ord(ch) <= 0xDCFF else len(ch.encode())
        out.append("�" if 0xDC80 <= ord(ch) <= 0xDCFF else ch)
        a.append(at * unit)
        b.append((at + n) * unit)
        at += n
    return "".join(out), a, b


def _unescape(run: str) -> tuple[str, list[int], list[int]]:
    if run.startswith("\\x"):
        return _chars(bytes.fromhex(run.replace("\\x", "")), 4)
    if run.startswith("\\u") and run[2] != "{":
        units, out, a, b, i = [int(run[k + 2 : k + 6], 16) for k in range(0, len(run), 6)], [], [], [], 0
        while i < len(units):
            n, code = 1, units[i]
            if 0xD800 <= code < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1] < 0xE000:
                n, code = 2, 0x10000 + ((code - 0xD800) << 10) + units[i + 1] - 0xDC00
            out.append("�" if 0xD800 <= code < 0xE000 else chr(code))
            a.append(6 * i)
            b.append(6 * (i + n))
            i += n
        return "".join(out), a, b
    digits = run[2:-1] if run[0] == "&" else run[3:-1] if run[2] == "{" else run[2:]
    code = int(digits[1:], 16) if digits[:1] in "xX" and run[0] == "&" else int(digits, 10 if run[0] == "&" else 16)
    return ("�" if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)), [0], [len(run)]


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with each match decoded, or None without a match."""
    parts, starts, ends, at = [], [], [], 0
    own_a = layer.starts if layer.starts is not None else np.arange(len(layer.text))
    own_b = layer.ends if layer.ends is not None else np.arange(1, len(layer.text) + 1)
    for m in pattern.finditer(layer.text):
        text, a, b = decode(m.group())
        parts += [layer.text[at : m.start()], text]
        starts += [own_a[at : m.start()], own_a[m.start() + np.array(a, np.int64)]]
        ends += [own_b[at : m.start()], own_b[m.start() + np.array(b, np.int64) - 1]]
        at = m.end()
    if not parts:
        return None
    return Layer("".join([*parts, layer.text[at:]]), np.concatenate([*starts, own_a[at:]]), np.concatenate([*ends, own_b[at:]]))


def _inflate(stream: io.BufferedIOBase) -> Iterator[bytes] | None:
    """The stream's plain bytes by pieces if it starts as a compressed one."""
    head = stream.peek(6)[:6]
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 1 and int.from_bytes(head[:2], "big") % 31 == 0):
        return _pump(stream, lambda: zlib.decompressobj(47), lambda d: d.unconsumed_tail)
    if head[:3] == b"BZh":
        return _pump(stream, bz2.BZ2Decompressor, None)
    if head[:6] == b"\xfd7zXZ\0":
        return _pump(stream, lzma.LZMADecompressor, None)
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return iter(lambda r=zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True): r.read(1 << 20), b"")
    return None


def _pump(stream, new, tail) -> Iterator[bytes]:
    """All members of the stream, one after the other."""
    inflater, data = new(), b""
    while True:
        if inflater.eof:
            data = inflater.unused_data or stream.read(1 << 16)
            if not data:
                return
            inflater = new()
        elif tail:
            data = inflater.unconsumed_tail or data or stream.read(1 << 16)
            if not data:
                return
        elif not data and inflater.needs_input:
            data = stream.read(1 << 16)
            if not data:
                return
        made, data = inflater.decompress(data, 1 << 20), b""
        if made:
            yield made


class _Pieces(io.RawIOBase):
    """Pieces of bytes as a stream."""

    def __init__(self, pieces: Iterator[bytes | memoryview]):
        self.pieces, self.rest = pieces, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.rest:
            try:
                self.rest = next(self.pieces)
            except StopIteration:
                return 0
        n = min(len(into), len(self.rest))
        into[:n], self.rest = self.rest[:n], self.rest[n:]
        return n


def _inner_texts(data: bytes | memoryview) -> Iterator[str]:
    """The text in a compressed stream, however often it was compressed, by overlapping pieces."""
    stream, seen = io.BufferedReader(_Pieces(iter([data]))), set()
    while (pieces := _inflate(stream)) is not None:
        stream = io.BufferedReader(_Pieces(pieces), 1 << 16)
        head = stream.peek(1 << 16)
        mark = hashlib.blake2b(head).digest()
        if mark in seen:  # a stream that unpacks to itself
            return
        seen.add(mark)
    decoder, held, least = codecs.getincrementaldecoder("utf-8")("replace"), "", _PIECE
    try:
        while block := stream.read1(1 << 20):
            held += decoder.decode(block)
            if len(held) >= least:
                yield held
                at = len(held) - _OVERLAP
                held = held[at - len(_OPEN.match(held[at - 1 :: -1])[0]) :]
                least = len(held) + _PIECE
    except _UNSOUND:
        pass  # what came before is scanned
    yield held + decoder.decode(b"", True)


def _from_base64(layer: Layer) -> Iterator[Layer]:
    """Each run's bytes as text, read from its first four characters on: what stands before the
    encoded part without a sign of its own (a path, a prefix, a key) shifts it by some of them.
    Compressed streams are looked for anywhere in those bytes."""
    runs = [(m.start(), m.end()) for m in _BASE64.finditer(layer.text)]
    if runs and "\n" in layer.text:
        runs += [(m.start(), m.end()) for m in _WRAPPED.finditer(layer.text)]
    for a, b in runs:
        own = layer.text[a:b]
        at = np.array([i for i, c in enumerate(own) if c not in "\r\n="], np.int64)
        digits = own.translate(_DIGITS)
        for shift in range(4):
            some = digits[shift:]
            some = some[: len(some) - (len(some) % 4 == 1)]
            data = base64.b64decode(some + "=" * (-len(some) % 4))
            places = at[shift : shift + len(some)]
            begins = lambda byte, places=places: places[byte // 3 * 4] + a
            if data.isascii():
                text, first = data.decode("ascii"), np.arange(len(data))
                last = first
            else:
                text, *found = _chars(data, 1)
                first, last = np.array(found[0], np.int64), np.array(found[1], np.int64) - 1
            lo, group = begins(first), last // 3 * 4 + 3
            hi = np.where(group >= len(places) - 1, b - 1 if len(some) + shift == len(at) else places[-1] + a, places[np.minimum(group, len(places) - 1)] + a)  # padding goes with the last group
            yield Layer(text, lo if layer.starts is None else layer.starts[lo], hi + 1 if layer.ends is None else layer.ends[hi])
            for m in _MAGIC.finditer(data):
                yield from _inflated(memoryview(data)[m.start() :], *layer.span(int(begins(m.start())), b))


def _inflated(data: bytes | memoryview, start: int, end: int) -> Iterator[Layer]:
    try:
        if data[:1] == b"\x78":  # two bytes say little: a bit of it must unpack
            zlib.decompressobj().decompress(data[:1024], 64)
        for piece in _inner_texts(data) if _inflate(io.BufferedReader(io.BytesIO(data[:16]))) is not None else ():
            yield Layer(piece, np.full(len(piece), start), np.full(len(piece), end))
    except _UNSOUND:
        return  # not a sound stream


def _escaped_streams(layer: Layer) -> Iterator[Layer]:
    """Compressed streams whose bytes are written as escapes, as text between them where that is plain."""
    for m in _BYTES.finditer(layer.text):
        data = _BYTE.sub(lambda x: chr(int(x[0][-2:], 16)), m[0]).encode("latin-1")
        yield from _inflated(data, *layer.span(m.start(), m.end()))


def unwrap(layer: Layer) -> Iterator[Layer]:
    if "%" in layer.text and (x := _rewritten(layer, _PERCENT, lambda r: _chars(bytes.fromhex(r.replace("%", "")), 3))):
        yield x
    if ("\\" in layer.text or "&#" in layer.text) and (x := _rewritten(layer, _ESCAPE, _unescape)):
        yield x
    if "%" in layer.text or "\\x" in layer.text:
        yield from _escaped_streams(layer)
    yield from _from_base64(layer)


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each (start, end, kind) in code points of the text, in order."""
    text = text or ""
    base = sorted(set(scan(text)), key=lambda x: (x[0], x[2], x[1]))
    spans, work, seen = set(base), deque(), set()
    work.append(unwrap(Layer(text, None, None)))
    while work:
        for layer in work.popleft():
            if layer.text and (key := layer.key()) not in seen:
                seen.add(key)
                spans |= {(*layer.span(a, b), kind) for a, b, kind in scan(layer.text)}
                work.append(unwrap(layer))
    return base, sorted(spans, key=lambda x: (x[0], x[2], x[1]))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: <id_col>, n_assign, n_access, n_hex, base_sha256 (of the base spans'
    list), spans (list of all spans).

    Every whole text is scanned; null counts as empty and has no span. Spans are kind:start:end by
    start, then kind in the order of KINDS, then end, comma-joined. Repeated rows repeat; extra
    columns are ignored; an empty table gives an empty result. Rows are independent: a lost
    executor's tasks simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                base, spans = find(x.as_py())
                rows.append((*(sum(k == i for *_, k in base) for i in range(3)), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], names=names)

    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str | None, spans: list[tuple[int, int, int]], sign: str = "*") -> str | None:
    """The text with every character of the spans replaced; its length stays."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, _ in sorted(spans):
        a = max(a, at)
        if b > a:
            out += [text[at:a], sign * (b - a)]
            at = b
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in text_col masked, in all layers; no row or column goes. A null stays
    null, an empty text empty, a text without secrets as it is; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.names.index(text_col)
            texts = [mask(t, find(t)[1]) for t in batch.column(i).to_pylist()]
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)
