"""Layers that hold more than plain text."""

import base64
import bz2
import gzip
import lzma
import random

import pytest
import zstandard

from tessella.llm import secrets

SECRET = "password=b7db7aa4a5fcc783059"


@pytest.mark.parametrize("more", ["\xa0", "　", "﻿", "​", "\xad", "\0", "\x1b"])
def test_base64_with_any_character(more):
    inner = base64.b64encode(f"{more}{SECRET}{more}".encode()).decode()
    twice = base64.b64encode(f"x {inner} {more}".encode()).decode()
    for run in (inner, twice):
        assert any(0 <= a and b <= len(run) and k == 0 for a, b, k in secrets.find(run)[1])


def test_base64_with_bytes_that_are_no_text():
    run = base64.b64encode(b"\xe9 " + SECRET.encode() + b" \xff").decode()
    assert any(k == 0 for *_, k in secrets.find(run)[1])


def found(run):
    return any(k == 0 for *_, k in secrets.find(run)[1])


@pytest.mark.parametrize("pack", [gzip.compress, bz2.compress, lzma.compress, zstandard.compress])
def test_every_part_of_a_compressed_layer(pack):
    encode = lambda data: base64.b64encode(data).decode()
    assert found(encode(pack(b"first ") + pack(SECRET.encode())))
    assert found(encode(pack(b"\xff " + SECRET.encode())))
    assert found("".join(f"%{c:02x}" for c in pack(SECRET.encode()))) and found("".join(f"\\x{c:02x}" for c in pack(SECRET.encode())))


def test_text_before_an_error_and_runs_across_pieces(monkeypatch):
    noise = random.Random(1).randbytes(3_000_000)
    assert found(base64.b64encode(gzip.compress(SECRET.encode() + b" " + noise)[:-1_000_000]).decode())
    monkeypatch.setattr(secrets, "_PIECE", 1_500_000)
    inner = base64.b64encode(b"a" * 1_200_000 + b" " + SECRET.encode())
    assert found(base64.b64encode(gzip.compress(b". " * 300_000 + inner + b" ." * 300_000)).decode())


@pytest.mark.parametrize("before", ["https://example.com/", "x/", "id-", "ab_", "a" * 17, "abc"])
@pytest.mark.parametrize("wrap", [lambda x: x, gzip.compress, bz2.compress])
def test_runs_that_something_stands_before(before, wrap):
    run = base64.b64encode(wrap(f"é {SECRET}".encode())).decode().rstrip("=")
    for tail in ("", "=", " end", "/more"):
        spans = [(a, b) for a, b, k in secrets.find(before + run + tail)[1] if k == 0]
        assert spans and all(len(before) <= a < b <= len(before + run + tail) for a, b in spans)


def _plain_scan(text):
    """The base spans by the contract's words, character by character."""
    out, low = [], "".join(c.lower() if c < "\x80" else c for c in text)
    value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    i = 0
    while i < len(text):
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(n, i)), None)
        end = None
        if name:
            j = i + len(name)
            j += text[j : j + 1] in ('"', "'") and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] in (":", "=") and j < len(text):
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                k = j
                while k < len(text) and text[k] in value:
                    k += 1
                if k > j:
                    end = k
                    if k - j >= 6:
                        out.append((i, k, 0))
        i = end or i + 1
    for first, more, least, kind in (("AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, 1), ("", set("0123456789abcdef"), 24, 2)):
        i = 0
        while i < len(text):
            j = i + len(first)
            while j < len(text) and text[j] in more:
                j += 1
            if text.startswith(first, i) and j > i + len(first):
                if j - i >= least:
                    out.append((i, j, kind))
                i = j
            else:
                i += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans_of_documents_by_a_plain_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    texts = [r.text or "" for r in rows] + ['token ="a', "ToKeN: 'abcdefg", "api_key:apikey=abcdef", "secretsecret=123456", "password = : abcdef", "AKIA" + "A" * 16 + " 0123456789abcdef0123456789" + "f" * 9]
    assert sum(len(_plain_scan(t)) for t in texts) >= 3
    for t in texts:
        assert secrets.find(t)[0] == _plain_scan(t)
