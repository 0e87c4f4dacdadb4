"""Language ID of web pages by Bayesian evidence fusion.

For each language, log P(language | page) is, but for a constant, the log prior of the page's host
plus the log likelihoods of its text, of the language its markup declares and of the one its
address hints at. Text likelihoods are naive Bayes over hashed byte trigrams, counted over all
documents by their language. The host prior is smoothed towards the domain's, that towards the
corpus'; it and the likelihoods of declarations and hints are grouped aggregates over all pages,
labelled by their text alone. A page doesn't count for its own host's prior.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut

#: Trigram buckets; languages at most (more raise an error); independent trigrams that a text's evidence counts for at most.
BUCKETS, LANGUAGES, EVIDENCE = 1 << 16, 256, 30.0
#: Pages that a parent's shares count for in its children's prior.
PRIOR = 5.0
_COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "jp": "ja", "cn": "zh", "ru": "ru"}
_HIDDEN = re.compile(r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->")
#: Second-level labels under which countries register domains.
_SECOND = {"ac", "co", "com", "edu", "gob", "gov", "ne", "net", "or", "org"}
_TAG = re.compile(r"(?s)<[^>]*>")
_DECLARED = (re.compile(r"""(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([A-Za-z]{2,3})\b"""), re.compile(r"""(?is)<meta\b[^>]*?(?:content-language|og:locale)["'][^>]*?content\s*=\s*["']\s*([A-Za-z]{2,3})\b"""))
_SEGMENT = re.compile(r"/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)")


def visible(page: str | None) -> str:
    """All text of a page that is shown, menus and footers too, without tags."""
    return entities.unescape(_TAG.sub(" ", _HIDDEN.sub(" ", page or "")))


def declared(page: str | None) -> str | None:
    for pattern in _DECLARED:
        if m := pattern.search(page or ""):
            return m[1].lower()
    return None


def address(url: str | None) -> tuple[str, str, str | None]:
    """Host, registered domain (its last two labels; three under a country's second-level label) and
    the language the address hints at."""
    try:
        parts = urlsplit(url or "")
        host, path = (parts.hostname or "").rstrip("."), parts.path
    except ValueError:
        return "", "", None
    labels = host.split(".")
    hint = m[1].lower() if (m := _SEGMENT.match(path)) else None
    if hint is None and len(labels) > 1:
        hint = _COUNTRY.get(labels[-1]) or (labels[0] if len(labels) > 2 and len(labels[0]) == 2 else None)
    deep = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in _SECOND
    return host, ".".join(labels[-3 if deep else -2 :]), hint


def _trigrams(text: str, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """The buckets of all byte trigrams of the text, in runs of about `most`."""
    whole = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-8", "replace"), np.uint8)
    for at in range(0, max(0, len(whole) - 2), most):
        raw = whole[at : at + most + 2].astype(np.uint32)
        code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        yield ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % BUCKETS


def _likelihoods(table: np.ndarray, text: str, evidence: float) -> tuple[np.ndarray, int]:
    """log P(text | language) for each language, tempered to `evidence` trigrams, and how many there are."""
    total, n = np.zeros(len(table)), 0
    for grams in _trigrams(text):
        total += table[:, grams].sum(1, dtype=np.float64)
        n += len(grams)
    return total * min(1.0, evidence / max(1, n)), n


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """The languages, and log P(trigram | language) of each bucket. Null languages don't count."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    langs = sorted(r["lang"] for r in known.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages; none is left out")
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang in number:
                    for grams in _trigrams(text.as_py() or ""):
                        held[number[lang]] += np.bincount(grams, minlength=BUCKETS)
        cells = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(held.reshape(-1)[cells])], names=["cell", "n"])

    counts = np.full(len(langs) * BUCKETS, 0.5)
    rows = known.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # bounded: languages by buckets
    counts[rows["cell"].to_numpy(np.int64)] += rows["n"].to_numpy(np.int64)
    counts = counts.reshape(len(langs), BUCKETS)
    return langs, np.log(counts / counts.sum(1, keepdims=True))


def _features(pages: DataFrame, langs: list[str], logs: np.ndarray, evidence: float, id_col: str, url_col: str, html_col: str) -> DataFrame:
    shared = pages.sparkSession.sparkContext.broadcast(logs.astype(np.float32))
    known = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows = []
            for url, page in zip(batch.column(1).to_pylist(), batch.column(2)):
                page = page.as_py()
                likely, grams = _likelihoods(table, visible(page), evidence)
                host, domain, hint = address(url)
                said = declared(page)
                code = lambda x: len(langs) + 1 if x is None else known.get(x, len(langs))
                rows.append((host, domain, code(said), code(hint), likely.tolist(), int(likely.argmax()) if grams else None))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kinds)], names=["id", "host", "domain", "said", "hint", "likely", "best"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"id {kind}, host string, domain string, said int, hint int, likely array<double>, best int")


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", evidence: float = EVIDENCE) -> DataFrame:
    """One row per page: <id_col>, host, text_lang, declared_lang, hint_lang, lang, confidence.

    All shown text of a page is read. Its trigrams overlap and come in bursts, so naive Bayes is far
    too sure of long texts; their log likelihood is tempered: the mean over all trigrams, times
    their number or `evidence`, whichever is less. Which language a text is likeliest in doesn't
    change by that, only how much other evidence it takes to overturn it.

    Null pages and addresses bring no evidence of their kind; a page without any takes the corpus'
    prior. Declarations and hints of no trained language count as one other. Ties go to the
    alphabetically first language. Repeated pages repeat; extra columns are ignored; empty pages
    give an empty result, and without a labelled document lang and confidence are null.
    """
    langs, logs = train(docs)
    kind = pages.schema[id_col].dataType.simpleString()
    if not langs:
        names = ("text_lang", "declared_lang", "hint_lang", "lang")
        host = F.parse_url(F.col(url_col), F.lit("HOST"))
        return pages.select(id_col, host.alias("host"), *[F.lit(None).cast("string").alias(n) for n in names], F.lit(None).cast("double").alias("confidence"))
    cut, n = Cut(pages.sparkSession, "language"), len(langs)
    rows = cut(_features(pages, langs, logs, evidence, id_col, url_col, html_col))
    each = [F.count(F.when(F.col("best") == i, 1)).alias(f"n{i}") for i in range(n)]
    hosts = cut(rows.groupBy("domain", "host").agg(*each))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in range(n)])
    corpus = np.array([x or 0 for x in hosts.agg(*[F.sum(f"n{i}") for i in range(n)]).first()], float)
    whole = (corpus + 1) / (corpus.sum() + n)
    # What pages of each language declare and hint at: a table of languages by languages.
    table = {k: np.full((n, n + 2), 1.0) for k in ("said", "hint")}
    for k, t in table.items():
        t[np.arange(n), np.arange(n)] += PRIOR  # most say what they are
        for r in rows.where("best is not null").groupBy("best", k).agg(F.count(F.lit(1)).alias("m")).collect():
            t[r["best"], r[k]] += r["m"]
    logs_of = {k: np.log(t / t.sum(1, keepdims=True)) for k, t in table.items()}
    priors = hosts.join(domains.withColumnRenamed("domain", "pdomain"), F.col("domain") == F.col("pdomain"))
    d_all, h_all = sum((F.col(f"d{i}") for i in range(n)), F.lit(0)), sum((F.col(f"n{i}") for i in range(n)), F.lit(0))
    priors = cut(priors.select(F.col("host").alias("phost"), h_all.alias("pages"), F.array(*[F.col(f"n{i}") for i in range(n)]).alias("own"), F.array(*[(F.col(f"d{i}") + PRIOR * float(whole[i])) / (d_all + PRIOR) for i in range(n)]).alias("above")))
    joined = rows.join(priors, F.col("host") == F.col("phost"))
    counts = F.col("best").isNotNull().cast("int")

    def evidence(i: int):
        mine = (F.coalesce(F.col("best"), F.lit(-1)) == i).cast("int")
        prior = F.log((F.col("own")[i] - mine + PRIOR * F.col("above")[i]) / (F.col("pages") - counts + PRIOR))
        said, hint = (F.element_at(F.array(*[F.lit(float(x)) for x in logs_of[k][i]]), F.col(k) + 1) for k in ("said", "hint"))
        return prior + F.col("likely")[i] + said + hint

    scored = joined.select("*", F.array(*[evidence(i) for i in range(n)]).alias("score")).withColumn("top", F.array_max("score"))
    share = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    name = lambda c: F.get(F.array(*map(F.lit, langs)), c)
    lang = name((F.array_position("score", F.col("top")) - 1).cast("int"))
    return scored.select(F.col("id").cast(kind).alias(id_col), "host", name(F.col("best")).alias("text_lang"), name(F.col("said")).alias("declared_lang"), name(F.col("hint")).alias("hint_lang"), lang.alias("lang"), share.alias("confidence"))
