"""The pipeline's near dedup against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import similar

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def plain_kept(texts):
    words = [(t or "").encode().lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    near = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    label = list(range(len(sets)))
    while (low := [min(label[j] for j, b in enumerate(sets) if near(a, b)) for a in sets]) != label:
        label = low
    return {i for i, x in enumerate(label) if x == i}


def test_near_copies_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    common, texts = [word() for _ in range(60)], ["", None, "one two", "One  two", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(20, 300))] + common * (rng.random() < 0.5)
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 30 + 1)):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own[rng.randint(0, len(own) // 8) :]))
    want = plain_kept(texts)
    rows = spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(texts)], DOC)
    assert {r.doc_id for r in similar.keep_one_each(rows).collect()} == want
    assert len(want) < len(texts) - 15 and similar.keep_one_each(rows).columns == rows.columns
    assert similar.keep_one_each(rows.limit(0)).count() == 0


def test_stage_removes_copies_that_fingerprints_miss(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id in (1, 6, 145, 177)")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()) == [1, 6]


def test_bands_meet_as_often_as_they_should():
    """Sets of a similarity of 0.8 share a band in 998 of 1000 cases."""
    dice, met, far = np.random.default_rng(3), 0, 0
    for _ in range(400):
        x = dice.integers(0, 1 << 64, 290, dtype=np.uint64)
        met += bool(set(similar.bands(np.sort(x[:245])).tolist()) & set(similar.bands(np.sort(x[27:272])).tolist()))  # 218 of 272 in common
        far += bool(set(similar.bands(x[:145]).tolist()) & set(similar.bands(x[100:245]).tolist()))  # 45 of 245
    assert met >= 394 and far <= 10
    assert len(similar.bands(np.zeros(0, np.uint64))) == 0


def test_recall_on_documents_by_all_pairs(spark):
    """Kept documents of sf0.001 are those that all pairs leave."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    ids, texts = zip(*[(r.doc_id, r.text) for r in rows.collect()])
    assert {r.doc_id for r in similar.keep_one_each(rows).collect()} == {ids[i] for i in plain_kept(texts)}


def test_odd_rows_of_similar_texts(spark):
    rows = [(None, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (4, "a b c d e f g"), (4, "a b c d e f g"), (3, "x"), (3, "y"), (5, ""), (6, "  \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("mark_", "id_", "root", "node", "key", "one")})
    got = similar.keep_one_each(df)
    assert got.columns == df.columns and sorted((str(r.doc_id), r.text) for r in got.collect()) == [("3", "x"), ("3", "y"), ("4", "a b c d e f g"), ("5", "")]


def test_similar_texts_without_a_shared_band_are_linked(spark):
    """A pair of similarity 0.8 that shares no band and isn't near by fingerprint."""
    rng = random.Random(1)
    while True:
        one = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        two = [*one[5:], *[f"w{rng.randrange(10**6)}" for _ in range(5)]]  # 40 of 50 sets of five in common
        x, y = (similar.word_set(" ".join(t)) for t in (one, two))
        if not set(similar.bands(x).tolist()) & set(similar.bands(y).tolist()):
            break
    assert (x.size, np.intersect1d(x, y).size) == (45, 40) and (similar.fold([x]) ^ similar.fold([y])).bit_count() > 2
    rows = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    assert [r.doc_id for r in similar.keep_one_each(rows).collect()] == [1]


def test_a_link_between_members_that_are_no_firsts_isnt_lost(spark):
    """Chains of sets of which only neighbours are similar, beside sets that share half of each."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts, half = [], [word() for _ in range(60)]
    for _ in range(12):
        run = half + [word() for _ in range(60)]
        for _ in range(6):
            texts.append(" ".join(run))
            run = run[11:] + [word() for _ in range(11)]
    rng.shuffle(texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in similar.keep_one_each(rows).collect()} == plain_kept(texts)


def test_the_stage_meets_by_balls_of_fingerprints(spark):
    """Fingerprints of two bits' difference meet, those of three don't."""
    sets = spark.createDataFrame([(1, 100, 0b0), (2, 100, 0b11), (3, 100, 0b11), (4, 90, 0b10011), (5, 100, 0b111 << 20), (6, 20, 0b1)], "node long, n int, fp long")
    got = {tuple(sorted((r.a, r.b))) for r in similar._balls(sets, similar.Cut(spark, "test")).collect()}
    assert got == {(1, 2), (2, 3), (2, 4)}


def test_parities_never_differ_more_than_sets():
    dice = np.random.default_rng(2)
    for n in (1, 5, 63, 64, 65, 300, 5000):
        x = np.unique(dice.integers(0, 1 << 64, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n * 4 // 5], dice.integers(0, 1 << 64, n // 3, dtype=np.uint64)]))
        bits = similar.differing(*[np.frombuffer(similar.parity(v), np.uint8) for v in (x, y)])
        assert bits <= len(np.setxor1d(x, y)) and bits % 2 == len(np.setxor1d(x, y)) % 2


def test_copies_changed_too_much_make_few_pairs(spark, monkeypatch):
    """Forty copies of a text in twenty parts, each changed in a twelfth of its words: none are similar, and none meet."""
    rng, seen, close = random.Random(7), [], similar._close
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(300)]
    texts = [" ".join(word() if rng.random() < 1 / 12 else w for w in base) for _ in range(40)]
    monkeypatch.setattr(similar, "_close", lambda pairs, sets, cut: seen.append(pairs.count()) or close(pairs, sets, cut))
    rows = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 20), "doc_id long, text string")
    assert similar.keep_one_each(rows).count() == 40 == len(plain_kept(texts))
    assert seen[0] < 40
