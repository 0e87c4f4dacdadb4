"""The corpus operators against brute force, public libraries and their defined edge cases."""

import base64
import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessella.llm import components, exact, language, lm, packing, quality, repeats, secrets, simhash, tokens
from tessella.llm.common import Cut

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = "password=b7db7aa4a5fcc783059"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(i + first, t, "en", None, None) for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, a repeated row, and columns named like results."""
    rows = [(0, None, "en"), (1, "", "en"), (2, "a b c", "de"), (3, "a b c", None), (3, "a b c", None), (None, "a b c", "en"), (None, None, "en"), (4, "x" * 300_000, "en"), (5, "wörd " * 30_000, "fr"), (6, SECRET, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    extra = {c: F.lit("mine") for c in ("kept", "fingerprint", "component_id", "keep_id", "digest", "id", "fp", "k", "a", "b", "n", "score", "row", "sequence_id", "spans", "n_tokens", "stats_", "fp_", "id_", "digest_")}
    return df.withColumns(extra)


OPERATORS = {
    "secrets": secrets.secret_spans, "exact": exact.exact_dedup, "simhash": simhash.near_dedup, "bpe": tokens.byte_round_trip, "lm": lm.score,
    "quality": lambda d: quality.apply_rules(d, []), "repeats": repeats.remove_repeats, "counts": tokens.token_counts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row_and_empty_tables(spark, odd, name):
    got = OPERATORS[name](odd)
    assert got.count() == odd.count()
    assert sorted(str(r.doc_id) for r in got.select("doc_id").collect()) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert OPERATORS[name](odd.limit(0)).count() == 0


# Secrets


@pytest.mark.parametrize("wrap", [
    lambda s: s.replace("=", "%3D"), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
    lambda s: base64.b64encode(s.encode()).decode(), lambda s: base64.b64encode(gzip.compress(s.encode())).decode(),
    lambda s: base64.b64encode(zlib.compress(base64.b64encode(gzip.compress(s.replace("=", "%3D").encode())))).decode(),
])
def test_encoded_secrets_map_to_their_wrapping(wrap):
    text = f"é {wrap(SECRET)} tail"
    base, spans = secrets.find(text)
    assert base == [] and (2, len(text) - 5, 0) in spans


def test_secret_base_rules():
    text = 'TOKEN: "abc" token = abcdef api_key=abcde AKIA' + "A" * 16 + " AKIA" + "A" * 15 + " " + "0a" * 12 + " " + "a" * 23
    kinds = Counter(k for *_, k in secrets.find(text)[0])
    assert kinds == {0: 1, 1: 1, 2: 1}
    assert secrets.listed(secrets.find("x token=abcdef")[0]) == "assign:2:14"


def test_masking_takes_effect(spark):
    got = secrets.without_secrets(frame(spark, [f"a {SECRET} b", None, "clean"])).orderBy("doc_id").collect()
    assert got[0].text == "a " + "*" * len(SECRET) + " b" and got[1].text is None and got[2].text == "clean"


# Exact and near dedup


def test_perfect_hash_is_minimal_and_loads_again():
    keys = np.random.default_rng(0).integers(0, 1 << 64, (5000, 4), dtype=np.uint64)
    mph = exact.PerfectHash.build(keys)
    again = exact.PerfectHash.load(mph.dump())
    assert sorted(mph.slots(keys)) == list(range(5000)) and (again.slots(keys) == mph.slots(keys)).all()


def test_exact_groups(spark):
    random.seed(2)
    texts = [random.choice(["a", "b ", "b", None, "", "c" * 50]) for _ in range(200)]
    got = {r.doc_id: r for r in exact.exact_dedup(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(same), len(same), i == max(same))
        assert got[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_dedup_stages_keep_one_row_of_each_group(spark, odd):
    kept = exact.keep_distinct(odd)
    assert kept.columns == odd.columns
    assert Counter((r.text or "")[:9] for r in kept.collect()) == {"": 1, "a b c": 1, "xxxxxxxxx": 1, "wörd wörd": 1, SECRET[:9]: 1}
    near = simhash.keep_one_each(odd)
    assert near.columns == odd.columns and Counter((r.text or "")[:5] for r in near.collect()) == {"": 1, "a b c": 1, "xxxxx": 1, "wörd ": 1, "passw": 1}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab É\n\t x", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(random.Random(1).choice(["ab", "c", "def"]) for _ in range(500))
    monkeypatch.setattr(simhash, "_BLOCK", 50)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_near_links_by_brute_force(spark):
    rng = random.Random(4)
    fps = []
    for _ in range(40):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.append(fp)
            for _ in range(rng.randint(0, 4)):
                fp ^= 1 << rng.randrange(64)
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "id long, fp long")
    cut = Cut(spark, "test")
    comp = {r.gfp: r.component_id for r in simhash.fingerprint_components(rows, cut).collect()}
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            low = min(label[j] for j, b in enumerate(fps) if (a ^ b).bit_count() <= 2)
            changed, label[i] = changed or low != label[i], low
    assert [comp[f - (1 << 64) if f >> 63 else f] for f in fps] == label


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), Cut(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + k: 100 for k in range(1, 50)}}


# Tokens


@pytest.fixture(scope="module")
def libraries():
    ranks = tokens.read_ranks(public_tokenizers.path(tokens.BYTE_RANKS))
    word = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_VOCAB))
    byte = tokens.byte_tokenizer(ranks, public_tokenizers.PATTERN)
    return byte, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), word, tokens.token_bytes(byte)


TEXT = st.lists(st.sampled_from([*"abcé  \n\t'sT0,.!漢😀́\x1c\x85　İⅣ", "the", "<|endoftext|>", "<|startoftext|>", "AKIA", " \n"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TEXT)
def test_encoders_match_the_libraries(libraries, text):
    byte, tik, word, table = libraries
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    ids = [i for v in tokens.Encoder(byte, public_tokenizers.PATTERN, False, lambda x: x).values(text) for i in v]
    assert ids == tik.encode_ordinary(text) and b"".join(table[i] for i in ids) == text.encode()
    whole = word.encode(text, add_special_tokens=False).ids
    assert [i for v in tokens.Encoder(word, pattern, True, lambda x: x).values(text) for i in v] == whole
    assert tokens.resynchronised_count(word, text * 30, 200, 70) == len(word.encode(text * 30, add_special_tokens=False).ids)


def test_token_counts_of_short_and_long_texts(spark, libraries):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["Ab ", "it's ", "é", "漢", "12", "<|endoftext|>", "\n"]) for _ in range(n)) for n in (0, 1, 50, 400, 3000)]
    got = {r.doc_id: r for r in tokens.token_counts(frame(spark, texts), chunk=500, limit=100).collect()}
    for i, text in enumerate(texts):
        n = len(libraries[2].encode(text, add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(text.encode()), n > 100)


def test_counts_without_a_common_boundary(libraries):
    text = "a" * 5000 + "é" * 3000
    assert tokens.resynchronised_count(libraries[2], text, 300, 80) == len(libraries[2].encode(text, add_special_tokens=False).ids)


# Language model


def test_base_scores_and_gain(spark):
    rng = random.Random(6)
    words = {k: [f"{k}{i}" for i in range(30)] for k in "xyz"}
    texts = [" ".join(rng.choice(words[k]) for _ in range(40)) for k in rng.choices("xyz", k=150)] + [None, "neverseen"]
    for near in (5, 10_000):
        got = {r.doc_id: r for r in lm.score(frame(spark, texts), near=near).collect()}
        tok = {i: (t or "").lower().split() + [None] for i, t in enumerate(texts)}
        held = {i for i in tok if zlib.crc32(str(i).encode()) % 5 == 1}
        c = Counter(w for i, ws in tok.items() if i not in held for w in ws)
        n, v = sum(c.values()), len(c)
        for i, ws in tok.items():
            assert got[i].held_out == (i in held) and got[i].train_tokens == n and got[i].n_tokens == len(ws)
            assert got[i].n_known == sum(c[w] > 0 for w in ws)
            assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


# Language ID


def test_language_evidence(spark):
    docs = spark.createDataFrame([("the of and with that this", "en"), ("der die das und nicht ein", "de"), ("x", None)] * 20, "text string, lang string")
    pages = [(0, "http://a.de/x", '<html lang="de"><p>die und das</p>'), (1, "http://b.com/en/1", "<p>the and of</p>"), (2, "http://b.com/en/2", ""), (3, None, None), (4, "http://[bad", "<html lang=en>")]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert len(got) == 5 and got[0].lang == "de" and got[1].lang == "en" and got[2].lang == "en" and got[4].lang == "en"
    assert got[0].declared_lang == "de" and all(0 < r.confidence <= 1 for r in got.values())
    assert language.identify(spark.createDataFrame(pages, "page_id long, url string, html string").limit(0), docs).count() == 0
    assert language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs.limit(0)).where("lang is null").count() == 5


# Quality


def plain_statistics(text):
    words, lines = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w], [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab#\n é\x1c\t", "a b\n", " a a"]), max_size=60).map("".join))
def test_statistics(text):
    assert quality.statistics(text)[:5] == plain_statistics(text)


def test_rules_learn_and_apply(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    good = [" ".join(word() for _ in range(rng.randint(25, 60))) for _ in range(120)]
    bad = [" ".join(word() + "$$" for _ in range(rng.randint(25, 60))) for _ in range(60)]
    docs = frame(spark, good + bad + ["too short", None])
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(0, 180, 2)] + [(999, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality.learn_rules(docs, labels)
    assert rules
    got = {r.doc_id: r.kept for r in quality.apply_rules(docs, rules).collect()}
    assert all(got[i] for i in range(120)) and not any(got[i] for i in range(120, 182))
    assert quality.keep_good(docs, rules).columns == docs.columns and quality.keep_good(docs, rules).count() == 120
    assert quality.learn_rules(docs, labels.limit(0)) == []


# Repeats


def plain_repeats(texts, length):
    at, out = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1)), []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if at[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(t, gone) if not g)
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [3, 24, 37])
def test_repeats(spark, length, monkeypatch):
    rng = random.Random(length)
    base = ["".join(rng.choice("abcd é") for _ in range(rng.randint(10, 200))) for _ in range(12)]
    piece = lambda: rng.choice(base)[rng.randint(0, 40) : rng.randint(40, 200)] if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60)))
    texts = ["".join(piece() for _ in range(rng.randint(0, 6))) for _ in range(60)] + ["a" * 300, "ab" * 100, "", None]
    texts += [texts[3], texts[3]]
    got = {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(frame(spark, texts), length).collect()}
    assert [got[i] for i in range(len(texts))] == plain_repeats([(t or "").encode() for t in texts], length)


def test_phrases_in_segments_cover_all_windows():
    data = bytes(random.Random(1).choice(b"abc") for _ in range(2000))
    a, b, m, *_ = repeats.phrases(data, 40)
    assert a[0] == 0 and b[-1] == len(data) - 40 and (a[1:] == b[:-1] + 1).all() and (m >= b).all() and (m - a < 30).all()


# Packing


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=25), st.sampled_from([100, 128]))
def test_plans_hold_every_piece_once(counts, limit):
    packed, got = packing.plan(counts, limit), Counter()
    for n, content in packed:
        assert n > 0 and sum(k * each for k, each in content) <= limit
        for k, each in content:
            got[k] += n * each
    assert got == counts
    total, bins = sum(k * n for k, n in counts.items()), sum(n for n, _ in packed)
    assert -(-total // limit) <= bins <= 2 * -(-total // limit) + 1


def test_a_rare_long_piece_leaves_frequent_ones_their_size():
    assert sum(n for n, _ in packing.plan({13: 32, 34: 1}, 100)) == 5
    assert sum(n for n, _ in packing.plan({1000: 100_000, 1400: 3}, 4096)) <= 25_002


def test_packing(spark, odd):
    docs = frame(spark, [" ".join(["word"] * (i * 7 % 60)) for i in range(200)] + [None, "long " * 300])
    got = packing.pack(docs, limit=64).toPandas().sort_values(["sequence_id", "offset"])
    word = Tokenizer.from_file(public_tokenizers.path(tokens.WORD_VOCAB))
    assert (got.groupby("sequence_id").length.sum() <= 64).all() and (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    for i, text in [(r.doc_id, r.text or "") for r in docs.collect()]:
        ids, own = word.encode(text, add_special_tokens=False).ids + [1], got[got.doc_id == i].sort_values("piece")
        parts = [ids[k : k + 64] for k in range(0, len(ids), 64)]
        assert own.piece.tolist() == list(range(len(parts))) and own.length.tolist() == [len(p) for p in parts]
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts]
    assert packing.pack(odd).groupBy().count().first()[0] >= 10 and packing.pack(odd.limit(0)).count() == 0


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.learn_rules(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id: r for r in quality.apply_rules(docs, rules).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if good[r.doc_id].kept]
    rows = [(i, t) for i, t in rows if i == max(j for j, u in rows if u == t)]
    runs = {}
    for i, t in rows:  # five words and a similarity of 0.8 or more, by all pairs
        words = (t or "").encode().lower().split()
        runs[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    label = {i: i for i in runs}
    near = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    pairs = [(i, j) for i in runs for j in runs if i < j and near(runs[i], runs[j])]
    for _ in runs:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    kept = {i: secrets.mask(t, secrets.find(t)[1]) for i, t in rows if label[i] == i}
    got = docs
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, got, sf)
        assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == kept
    packed = C.run(spark, sf).toPandas()
    assert set(packed.doc_id) == set(kept) and (packed.groupby("sequence_id").length.sum() <= 4096).all()
