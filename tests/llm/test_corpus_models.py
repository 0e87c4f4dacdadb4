"""The corpus models against plain recomputation: class bigrams, language evidence, rules."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import frame

from tessella.llm import common, language, lm, quality
from tessella.llm.common import Cut


def _corpus(n=150):
    rng = random.Random(6)
    words = {k: [f"{k}{i}" for i in range(30)] for k in "xyz"}
    return [" ".join(rng.choice(words["xyz"[j % 3]]) for j in range(rng.randint(0, 40))) for _ in range(n)] + [None, "neverseen"]


def test_class_model_by_plain_recomputation(spark):
    texts, cut = _corpus(), Cut(spark, "test")
    docs = frame(spark, texts)
    tokens = {i: [w.encode() for w in (t or "").lower().split()] for i, t in enumerate(texts)}
    train = [tokens[i] for i in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in train for w in t)
    top = lm._frequent(lm.word_counts(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1)), 100_000)
    units = lm.Units([bytes(r["w"]) for r in top[: lm.MOST_OWN]])
    follows = cut(lm.unit_pairs(frame(spark, [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]), units))
    plain = Counter(p for t in train for p in zip([units.end, *map(units.of, t)], [*map(units.of, t), units.end]))
    assert {divmod(r["cell"], units.end + 1): r["n"] for r in follows.collect()} == plain
    classes, pairs, passes = lm.learn_classes(follows, units)
    assert passes == sorted(passes) and len(passes) > 1  # each pass raises the likelihood
    by_class = Counter()
    for (u, v), n in plain.items():
        by_class[classes[u], classes[v]] += n
    assert all(pairs[a, b] == by_class[a, b] for a in range(len(pairs)) for b in range(len(pairs)))
    kind = lambda w: int(classes[units.end if w is None else units.of(w)])
    counts[None] = len(train)
    size, types = Counter(), Counter()
    for w, n in counts.items():
        size[kind(w)] += n
        types[kind(w)] += 1
    k, total, last = len(pairs), sum(counts.values()), len(pairs) - 1
    whole = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * k)
    got = {r.doc_id: r.score for r in lm.score(docs).collect()}
    for i, t in tokens.items():
        score, before = 0.0, last
        for w in [*t, None]:
            c = kind(w)
            follow = (pairs[before, c] + 50 * whole[c]) / (pairs[before].sum() + 50)
            room = size[c] + 0.5 * (max(1, types[c]) if c == last else types[c] + 1)
            n = counts.get(w, 0) + 0.5
            score += math.log10(lm.SHARE * follow * n / room + (1 - lm.SHARE) * n / (total + 0.5 * (len(counts) + k - 1)))
            before = c
        assert got[i] == pytest.approx(score, abs=1e-9)


def test_words_move_by_their_own_neighbours_and_texts_are_classed_once(spark, monkeypatch):
    texts, calls, cut = _corpus(), [], Cut(spark, "test")
    tokens = [[w.encode() for w in (t or "").lower().split()] for t in texts]
    units = lm.Units(sorted({w for t in tokens for w in t})[::3], 8)
    classes = np.append(np.arange(units.end) % 4, 4)
    pairs, met = np.zeros((5, 5)), defaultdict(Counter)
    for t in tokens:
        c = [4, *(int(classes[units.of(w)]) for w in t), 4]
        for a, w, b in zip(c, t, c[2:]):
            met[w][a, b] += 1
        for a, b in zip(c, c[1:]):
            pairs[a, b] += 1
    follow = np.log((pairs + 0.1) / (pairs.sum(1)[:, None] + 0.5))
    lead = np.log((pairs + 0.1) / (pairs.sum(0)[None] + 0.5))
    best = {w: [sum(n * (lead[a, k] + follow[k, b]) for (a, b), n in own.items()) for k in range(4)] for w, own in met.items() if w not in units.own}
    got = {bytes(r.ow): r.oc for r in lm._own_classes(frame(spark, texts).repartition(3), units, classes, pairs).collect()}
    assert got.keys() == best.keys() and all(best[w][k] == pytest.approx(max(best[w]), abs=1e-5) for w, k in got.items())
    classed = lm._classed
    monkeypatch.setattr(lm, "MOST_OWN", 4)
    monkeypatch.setattr(lm, "_classed", lambda *a: calls.append(1) or classed(*a))
    rng = random.Random(8)
    texts = [" ".join(f"{'pq'[j % 2]}{rng.randrange(40):02}ing" for j in range(40)) for _ in range(120)]
    assert lm.score(frame(spark, texts), near=7).count() == len(texts)
    assert len(calls) == 1  # the words' moves help at once


def test_texts_come_in_small_batches_and_near_words_need_no_worker(spark, monkeypatch):
    """Ten thousand texts at once, and workers of another kind, took an executor beyond its memory."""
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text")).mapInArrow(sizes, "n long")
    for small, least, most in ((True, 3, common.BATCH_BYTES + 10_000), (False, 1, 1 << 30)):
        found = [r.n for r in Cut(spark, "test", small=small)(rows).collect()]
        assert len(found) >= least and max(found) <= most and sum(found) > 16_000_000
    assert spark.conf.get(common._BATCH_CONF, None) is None
    docs, seen = frame(spark, _corpus()), []
    write = Cut.__call__
    monkeypatch.setattr(Cut, "__call__", lambda self, df: seen.append(self.batches) or write(self, df))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert lm.score(docs, near=7).count() == docs.count()
    assert set(seen) == {common.small_batches}


def test_class_model_is_a_distribution():
    """Over all words and one unseen word of each class, probabilities add up to one."""
    classes, pairs = np.array([0, 0, 1, 2]), np.array([[3.0, 2, 1], [1, 0, 4], [2, 3, 0]])
    counts = [(4, 0), (2, 0), (5, 1), (5, 2)]  # count, class; the last is the end
    sizes, types = np.array([6.0, 5, 5]), np.array([2.0, 1, 1])
    model = lm._model(lm.Units([]), classes, pairs, sizes, types, lm.SHARE)
    for before in range(3):
        seen = sum((n + 0.5) * model.factor[before, c] for n, c in counts)
        unseen = sum(0.5 * model.factor[before, c] for c in (0, 1))
        assert seen + unseen == pytest.approx(1, abs=0.01)


def test_words_that_are_equally_frequent_still_have_units(spark):
    rows = spark.createDataFrame([(f"w{i}".encode(), 1) for i in range(3000)] + [(b"often", 9)], "w binary, n long")
    got = lm._frequent(rows, 500)
    assert bytes(got[0]["w"]) == b"often" and 400 < len(got) <= 500
    assert lm._frequent(rows, 5000)[0]["n"] == 9 and len(lm._frequent(rows, 5000)) == 3001


DOCS = [("the of and with that this", "en"), ("der die das und nicht ein", "de"), ("x", None)] * 20
PAGES = [(i, f"http://a{i % 3}.site.de/", f'<html lang="de"><p>der die das nicht {i}</p>') for i in range(30)]


def test_other_evidence_overturns_little_text(spark):
    docs = spark.createDataFrame(DOCS, "text string, lang string")
    pages = [*PAGES, (90, "http://a1.site.de/x", '<html lang="de"><p>that</p>'), (91, "http://a1.site.de/y", f'<html lang="de"><p>{"that this with of " * 40}</p>')]
    got = {r.page_id: r for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs, evidence=1.0).collect()}
    assert got[90].text_lang == "en" and got[90].lang == "de"  # a word says less than host, markup and address
    assert got[91].text_lang == "en"


def test_posteriors_by_plain_recomputation(spark):
    docs = spark.createDataFrame(DOCS, "text string, lang string")
    pages = [*PAGES, (90, "http://b.com/en/", "<p>the of</p>"), (91, None, None), (92, "http://a1.site.de", "<html lang=fr><p>und of</p>"), (92, "http://a1.site.de", "<html lang=fr><p>und of</p>")]
    got = defaultdict(list)
    for r in language.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect():
        got[r.page_id].append(r)
    langs, table = language.train(docs)
    table = table.astype(np.float32)
    rows = []
    for i, url, page in pages:
        likely, n = language._likelihoods(table, language.visible(page), language.EVIDENCE)
        host, domain, hint = language.address(url)
        code = lambda x: 3 if x is None else langs.index(x) if x in langs else 2
        rows.append((i, host, domain, code(language.declared(page)), code(hint), likely, int(likely.argmax()) if n else None))
    best = Counter(r[6] for r in rows if r[6] is not None)
    whole = [(best[k] + 1) / (sum(best.values()) + 2) for k in range(2)]
    logs = []
    for c in (3, 4):
        t = np.ones((2, 4))
        t[np.arange(2), np.arange(2)] += language.PRIOR
        for r in rows:
            if r[6] is not None:
                t[r[6], r[c]] += 1
        logs.append(np.log(t / t.sum(1, keepdims=True)))
    for i, host, domain, said, hint, likely, own in rows:
        score = []
        for k in range(2):
            of = lambda c, v: [r[6] for r in rows if r[c] == v and r[6] is not None]
            above = (of(2, domain).count(k) + language.PRIOR * whole[k]) / (len(of(2, domain)) + language.PRIOR)
            prior = (of(1, host).count(k) - (own == k) + language.PRIOR * above) / (len(of(1, host)) - (own is not None) + language.PRIOR)
            score.append(math.log(prior) + likely[k] + logs[0][k, said] + logs[1][k, hint])
        top = max(score)
        for r in got[i]:
            assert r.lang == langs[score.index(top)] and r.confidence == pytest.approx(1 / sum(math.exp(s - top) for s in score))


def test_odd_pages(spark):
    docs = spark.createDataFrame(DOCS, "text string, lang string")
    rows = [(None, None, None), (1, "", ""), (1, "", ""), (2, "http://x.co.uk/", "<p>" + "the of " * 100_000), (3, "http://[bad", "\0")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("mine") for c in ("lang", "host", "id", "best", "score", "own", "pages", "said")})
    got = language.identify(pages, docs)
    assert sorted(str(r.page_id) for r in got.collect()) == ["1", "1", "2", "3", "None"]
    assert language.identify(pages.limit(0), docs).count() == 0 and got.where("lang is null").count() == 0
    assert language.address("http://a.b.co.uk/x")[1] == "b.co.uk" and language.address("http://a.co.de/")[1] == "a.co.de" and language.address("http://co.uk/")[1] == "co.uk"


def test_long_texts_lose_no_trigram():
    text = " ".join(random.Random(1).choice(["ab", "cde", "é", "f"]) for _ in range(5000))
    whole = np.concatenate(list(language._trigrams(text)))
    assert (np.concatenate(list(language._trigrams(text, 100))) == whole).all() and len(whole) == len(f" {text} ".encode()) - 2


def test_repeated_ids_count_once_in_learning(spark):
    docs = frame(spark, ["word " * 30] * 50).unionByName(frame(spark, ["$$ " * 30] * 50, 50))
    labels = spark.createDataFrame([(i, int(i < 50), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    once = quality.learn_rules(docs, labels)
    many = docs
    for _ in range(4):
        many = many.unionByName(docs)
    assert once and quality.learn_rules(many, labels) == once


def test_words_without_units_have_classes_of_their_own(spark, monkeypatch):
    """Words of one suffix that stand at different places: in one class they'd score as the base does."""
    monkeypatch.setattr(lm, "MOST_OWN", 4)
    rng = random.Random(8)
    texts = [" ".join(f"{'pq'[j % 2]}{rng.randrange(40):02}ing" for j in range(40)) for _ in range(120)]
    rows = lm.score(frame(spark, texts), near=7).where("held_out").collect()
    assert sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows) > 0.05
