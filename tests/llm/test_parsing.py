"""Corpus order by prefix-free parsing, and the repeats found by it, against brute force."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from test_operators import frame, plain_repeats

from tessella.llm import parsing, repeats


def _texts(rng):
    base, out = bytes(rng.choice(b"ab") for _ in range(60)), []
    for _ in range(rng.randint(1, 6)):
        out.append(rng.choice([
            bytes(rng.choice(b"abc\x00\xff") for _ in range(rng.randint(0, 80))),
            base[rng.randint(0, 30) :] + bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 20))),
            b"a" * rng.randint(0, 70) + b"ab" * rng.randint(0, 20),
        ]))
    return out


@pytest.mark.parametrize("every", [1, 2, 32])
def test_corpus_order_and_repeated_places(every, monkeypatch):
    monkeypatch.setattr(parsing, "EVERY", every)
    for seed in range(300):
        rng = random.Random(seed)
        texts, length = _texts(rng), rng.choice([1, 3, 9, 24])
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        rest = {int(offsets[i]) + j: t[j:] for i, t in enumerate(texts) for j in range(len(t) - length + 1)}
        places = np.array(list(rest), np.int64)
        order = [rest[p] for p in parsing.corpus_order(data, offsets, places).tolist()]
        assert order == sorted(order)
        times = Counter(x[:length] for x in rest.values())
        assert parsing.repeated_places(data, offsets, places, length).tolist() == [p for p, x in rest.items() if times[x[:length]] > 1]


def test_memory_of_ordering():
    """Two workers of an executor order several MB each; 60 bytes for each byte were too many."""
    rng = np.random.default_rng(4)
    pool, sizes = rng.integers(0, 256, 300_000, np.uint8), rng.integers(400, 700, 1800)
    data, offsets = np.concatenate([pool[a : a + n] for a, n in zip(rng.integers(0, 299_000, len(sizes)), sizes)]), np.concatenate([[0], np.cumsum(sizes)])
    n = sizes - 399
    places = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    tracemalloc.start()
    hit = parsing.repeated_places(data, offsets, places, 400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    times = Counter(data[p : p + 400].tobytes() for p in places.tolist())
    assert hit.tolist() == [p for p in places.tolist() if times[data[p : p + 400].tobytes()] > 1] and len(hit)
    assert peak < 40 * len(data)


def test_no_place_in_few_bytes():
    few = np.zeros(3, np.uint8)
    assert len(parsing.repeated_places(few, np.array([0, 3]), np.zeros(0, np.int64), 400)) == 0


def _passages(rng):
    """Texts that share passages around and beyond 400 bytes, one of them very often, and copies."""
    word = lambda: "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (40, 70, 75, 80, 90, 150, 400)]
    texts = [prose(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 30) :] + prose(rng.randint(0, 60)) for _ in range(60)]
    texts += [f"{i} {prose(3)}{shared[-1]}{prose(2)}" for i in range(60)]
    return texts + texts[:4] + ["the " * 500, "of the " * 400, "a" * 399, "a" * 400, "", None]


@pytest.mark.parametrize("group", [8192, 8])
def test_repeats_of_400_bytes(spark, group, monkeypatch):
    """With small groups the common passage's phrases go on as blocks and single windows."""
    monkeypatch.setattr(repeats, "GROUP", group)
    texts = _passages(random.Random(group))
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats([(t or "").encode() for t in texts], 400)


def test_frequent_keys_and_rare_ones_are_joined_alike(spark):
    rows = spark.createDataFrame([(i, 7 if i < 1500 else i) for i in range(3000)], "i long, k long")
    keys = spark.createDataFrame([(7, 1500), (1600, 1), (1601, 1)], "k long, n long")
    assert sorted(r.i for r in repeats._semi(rows, keys, ["k"], 3000).collect()) == [*range(1500), 1600, 1601]


def test_equal_hashes_are_no_equality(spark):
    """A Thue-Morse string and its complement, for which polynomials modulo 2^64 collide."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(4096))
    texts = [one[:2048], one[2048:]]
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(frame(spark, texts), 1024).collect()}
    assert [got[i] for i in range(2)] == plain_repeats([t.encode() for t in texts], 1024)
