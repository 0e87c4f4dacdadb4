"""Small fits, filters and solvers, as queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits
from .queries import PTS, q, query, table_query

_DOCS = "o AS (SELECT lang, doc_id, (doc_id % 4)::INT AS fold, round(least(n_chars, 20000) / 20000.0, 6) AS x, quality::DOUBLE AS y FROM documents JOIN labels USING (doc_id))"
_FIT = f"""{_DOCS}, tr AS (SELECT lang, m.model, x, y FROM o, (SELECT unnest(range(4))::INT AS model) m WHERE fold <> model),
    ft AS (SELECT lang, model, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0 AS n FROM (SELECT DISTINCT lang FROM o), (SELECT unnest(range(4))::INT AS model)
      UNION ALL SELECT lang, model, a + ((h2 + 0.5) * g0 - h1 * (g1 - 0.5 * b)) / (h0 * (h2 + 0.5) - h1 * h1), b + (h0 * (g1 - 0.5 * b) - h1 * g0) / (h0 * (h2 + 0.5) - h1 * h1), n + 1
      FROM (SELECT lang, model, a, b, n, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * x) AS h1, sum(p * (1 - p) * x * x) AS h2 FROM (SELECT f.lang, f.model, f.a, f.b, f.n, t.x, t.y, 1 / (1 + exp(-(f.a + f.b * t.x))) AS p FROM ft f JOIN tr t ON t.lang = f.lang AND t.model = f.model WHERE f.n < 10) GROUP BY 1, 2, 3, 4, 5)),
    sc AS (SELECT o.lang, o.doc_id, o.fold, o.y::INT AS label, 1 / (1 + exp(-(a + b * x))) AS p FROM o JOIN ft ON ft.lang = o.lang AND ft.model = o.fold AND ft.n = 10)"""


def _scored(t):
    d = t("documents").join(t("labels"), "doc_id").where("lang is not null and quality is not null")
    return fits.logistic_folds(d.select("lang", F.col("doc_id").alias("item"), F.round(F.least("n_chars", F.lit(20000)) / 20000.0, 6).alias("x"), "quality"), "lang", "item", F.col("item") % 4, 4, "x", "quality", 0.5)


@table_query(f"WITH RECURSIVE {_FIT} SELECT lang, doc_id AS item, fold, label, {q('p')} AS p FROM sc")
def logistic_folds(t):
    return _scored(t)


@table_query(f"""WITH RECURSIVE {_FIT}, c AS (SELECT lang, label, fold, round(CASE WHEN label = 1 THEN 1 - p ELSE p END, 6) AS c FROM sc), e AS (SELECT lang, doc_id, fold, label, 1 AS cls, round(1 - p, 6) AS odd FROM sc UNION ALL SELECT lang, doc_id, fold, label, 0, round(p, 6) FROM sc),
    v AS (SELECT e.lang, e.doc_id, e.label, e.cls, (1 + count(c.c) FILTER (c.c >= e.odd)) / (1.0 + count(c.c)) > 0.1 AS kept FROM e LEFT JOIN c ON c.lang = e.lang AND c.label = e.cls AND c.fold <> e.fold GROUP BY e.lang, e.doc_id, e.label, e.cls, e.odd),
    r AS (SELECT lang, doc_id, label, sum(kept::INT) AS size, max((kept AND cls = label)::INT) AS hit FROM v GROUP BY 1, 2, 3) SELECT lang, label, count(*) AS rows, {q('avg(hit)')} AS covered, {q('avg(size)')} AS mean_size FROM r GROUP BY 1, 2""")
def conformal_sets(t):
    return fits.conformal_sets(_scored(t), "lang", 0.1)


@query(f"""WITH c AS (SELECT l_suppkey AS o, l_linenumber AS i, count(*) AS n, avg(l_quantity::DOUBLE) AS m, var_samp(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY 1, 2), w AS (SELECT sum((n - 1) * v) FILTER (n > 1) / sum(n - 1) FILTER (n > 1) AS w FROM c), u AS (SELECT o, count(*) AS k, avg(m) AS mm, var_samp(m) AS vm, avg(1.0 / n) AS inv FROM c GROUP BY 1),
    s AS (SELECT any_value(w) AS w, greatest(0.0, coalesce(avg(vm - w * inv) FILTER (k > 1), 0)) AS i, var_samp(mm) AS vo, avg(w * inv / k) AS wi, avg(1.0 / k) AS ik FROM u, w), t AS (SELECT w, i, greatest(0.0, coalesce(vo, 0) - i * ik - wi) AS o FROM s) SELECT {q('o / (o + i + w)')} AS "outer", {q('i / (o + i + w)')} AS "inner", {q('w / (o + i + w)')} AS within FROM t""")
def variance_shares(pts):
    return fits.variance_shares(pts, "pattern_id", "component", "value")


def _newton(n: int) -> str:
    out = "SELECT pattern_id, k, n, 0.0::DOUBLE AS x FROM s"
    for _ in range(n):
        out = f"SELECT pattern_id, k, n, x + (k - n * p - 0.25 * x) / (n * p * (1 - p) + 0.25) AS x FROM (SELECT *, 1 / (1 + exp(-x)) AS p FROM ({out}))"
    return out


@query(f"""WITH {PTS}, s AS (SELECT pattern_id, sum(mark)::DOUBLE AS k, count(*)::DOUBLE AS n FROM pts GROUP BY 1), f AS (SELECT *, 1 / (1 + exp(-x)) AS p FROM ({_newton(8)}))
    SELECT pattern_id, {q('x')} AS mode, {q('1 / sqrt(n * p * (1 - p) + 0.25)')} AS deviation, {q('k * x - n * ln(1 + exp(x)) - 0.125 * x * x + 0.5 * ln(0.25 / (n * p * (1 - p) + 0.25))', 4)} AS log_evidence FROM f""")
def laplace_share(pts):
    counts = pts.groupBy("pattern_id").agg(F.sum("mark").alias("k"), F.count(F.lit(1)).alias("n"))
    return fits.laplace_share(counts, "pattern_id", "k", "n", 2.0).withColumn("log_evidence", F.round(F.col("log_evidence") + 3.7e-9, 4))


@table_query(f"""WITH RECURSIVE e AS (SELECT user_id::BIGINT AS series, event_id::BIGINT AS t, value::DOUBLE / 10 AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    f AS (SELECT series, t, k, y, 0.0::DOUBLE AS m0, 4.0::DOUBLE AS v0, 4.0 / 5.0 * y AS m, (1 - 4.0 / 5.0) * 4.0 AS v FROM e WHERE k = 1
      UNION ALL SELECT series, t, k, y, m0, v0, m0 + g * (y - m0 - m0 * m0 / 20), (1 - g * h) * v0 FROM (SELECT *, v0 * h / (h * h * v0 + 1) AS g FROM (SELECT e.series, e.t, e.k, e.y, f.m + 0.3 * sin(f.m) AS m0, pow(1 + 0.3 * cos(f.m), 2) * f.v + 0.5 AS v0, 1 + (f.m + 0.3 * sin(f.m)) / 10 AS h FROM f JOIN e ON e.series = f.series AND e.k = f.k + 1)))
    SELECT series, t, {q('m')} AS filtered, {q('v')} AS variance FROM f""")
def extended_filter(t):
    e = t("events").select(F.col("user_id").cast("long").alias("series"), F.col("event_id").cast("long").alias("t"), (F.col("value").cast("double") / 10).alias("value"))
    return fits.extended_filter(e, 0.3, 0.5, 1.0, 0.0, 4.0)


_LEFT, _RIGHT = "u[CASE WHEN i = 1 THEN 64 ELSE i - 1 END]", "u[CASE WHEN i = 64 THEN 1 ELSE i + 1 END]"
_BEND = f"({_LEFT} - 2 * w + {_RIGHT})"
_BENDV = _BEND.replace("u[", "v[").replace("* w", "* v[i]")


@table_query(f"""WITH RECURSIVE s AS (SELECT s_suppkey::BIGINT AS key, ['phase', 'carried', 'pattern'][s_suppkey % 3 + 1] AS kind, [1.0, 0.6, 0.04][s_suppkey % 3 + 1] AS a, [0.01, 0.05, 0.06][s_suppkey % 3 + 1] * (1 + s_suppkey % 4 / 10.0) AS b, 0.2 + s_suppkey % 5 / 20.0 AS d FROM supplier),
    st AS (SELECT key, kind, a::DOUBLE AS a, b::DOUBLE AS b, d::DOUBLE AS d, 0 AS n, list_transform(range(64), lambda i: CASE WHEN i >= 16 AND i < 32 THEN CASE WHEN kind = 'pattern' THEN 0.5 ELSE 0.8 END ELSE CASE kind WHEN 'pattern' THEN 1.0 WHEN 'phase' THEN -0.2 ELSE 0.0 END END::DOUBLE) AS u, list_transform(range(64), lambda i: CASE WHEN i >= 16 AND i < 32 THEN 0.25 ELSE 0.0 END::DOUBLE) AS v FROM s
      UNION ALL SELECT key, kind, a, b, d, n + 1, list_transform(u, lambda w, i: CASE kind WHEN 'phase' THEN w + 0.5 * (d * {_BEND} + a * (w - w * w * w) + b) WHEN 'carried' THEN w + 0.5 * (d * {_BEND} - a * (w - {_LEFT}) + b * (1 - w)) ELSE w + 0.5 * (d * {_BEND} - w * v[i] * v[i] + a * (1 - w)) END),
        list_transform(u, lambda w, i: CASE WHEN kind = 'pattern' THEN v[i] + 0.5 * (d / 2 * {_BENDV} + w * v[i] * v[i] - (a + b) * v[i]) ELSE v[i] END) FROM st WHERE n < 120)
    SELECT key, kind, {q('list_avg(u)')} AS mean, {q('list_stddev_pop(u)')} AS spread, {q('list_max(u)')} AS top FROM st WHERE n = 120""")
def ring_fields(t):
    k = F.col("s_suppkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % 3 + 1).cast("int"))
    return fits.ring_fields(t("supplier").select(k.alias("key"), pick("phase", "carried", "pattern").alias("kind"), pick(1.0, 0.6, 0.04).alias("a"), (pick(0.01, 0.05, 0.06) * (1 + k % 4 / 10.0)).alias("b"), (0.2 + k % 5 / 20.0).alias("diffusion")), 64, 0.5, 120)
