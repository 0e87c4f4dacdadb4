"""Marks, scales, checks, digests and small nulls, as queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import workflow
from ..operators import models, records
from .queries import _MODES, _SC, PR, PTS, WINDOW, _scores, draw, q, query, shuffle, table_query, unit

_P = "PARTITION BY pattern_id"


@query(f"WITH {PTS} SELECT pattern_id, count(*) AS n, sum((pa >= 0.25)::INT)::BIGINT AS at_least, sum((pa < 0.1)::INT)::BIGINT AS below FROM pts GROUP BY 1")
def threshold_marks(pts):
    marked = pts.withColumns({"a": records.threshold_mark(F.col("pa"), "at_least", 0.25), "b": records.threshold_mark(F.col("pa"), "below", 0.1)})
    return marked.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("at_least"), F.sum("b").alias("below"))


@query(f"WITH {PTS}, b AS (SELECT pattern_id, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS d FROM pts GROUP BY 1) SELECT pattern_id, {q('sqrt(4 * 1000000.0 / pi())')} AS equivalent_diameter, {q('nullif(d, 0)')} AS diagonal, {q('0.25 * nullif(d, 0)')} AS largest_scale FROM b")
def length_scales(pts):
    return records.length_scales(pts, 1e6, 0.25)


@query(f"""WITH {PTS}, v AS (SELECT pattern_id, value / 50 + CASE WHEN pattern_id % 3 = 0 THEN idx / 1e14 ELSE 0 END AS v, row_number() OVER ({_P} ORDER BY idx) AS k, count(*) OVER ({_P}) AS n FROM pts),
    s AS (SELECT pattern_id, count(*) AS n, max(v) - min(v) AS range, avg(v) FILTER (k > n // 2) - avg(v) FILTER (k <= n // 2) AS drift FROM v GROUP BY 1) SELECT pattern_id, n, {q('range')} AS range, {q('drift')} AS drift, n >= 8 AND range > 0.25 AND abs(drift) > 0.2 AS suspect FROM s""")
def stain_gradient(pts):
    return records.stain_gradient(pts.withColumn("od", F.col("value") / 50 + F.when(F.col("pattern_id") % 3 == 0, F.col("idx") / 1e14).otherwise(0.0)), "od")


@query(f"WITH {PTS}, k AS (SELECT pattern_id, floor(x / 100)::BIGINT AS bin, label, count(*) AS k FROM pts GROUP BY 1, 2, 3) SELECT pattern_id, bin, count(*) AS strata, bool_and(k >= 12) AS eligible FROM k GROUP BY 1, 2")
def eligible_bins(pts):
    return records.eligible_everywhere(pts.withColumn("bin", F.floor(F.col("x") / 100)), ["pattern_id", "bin"], "label", 12)


@table_query("""WITH l AS (SELECT '  ' || c_mktsegment || '   X ' || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE (c_custkey % 3)::VARCHAR END AS s FROM customer UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN '   ' ELSE n_name END FROM nation)
    SELECT nullif(lower(regexp_replace(trim(s, ' '), '\\s+', ' ', 'g')), '') AS label, count(*) AS n FROM l GROUP BY 1""")
def normalised_labels(t):
    a = t("customer").select(F.concat(F.lit("  "), "c_mktsegment", F.lit("   X "), F.when(F.col("c_custkey") % 5 == 0, "").otherwise((F.col("c_custkey") % 3).cast("string"))).alias("s"))
    b = t("nation").select(F.when(F.col("n_nationkey") % 2 == 0, "   ").otherwise(F.col("n_name")).alias("s"))
    return a.union(b).groupBy(records.normalised_label(F.col("s")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PTS}, k AS (SELECT pattern_id, label, count(*) AS k FROM pts GROUP BY 1, 2) SELECT pattern_id, string_agg(label || '=' || k, ',' ORDER BY label) AS factors, max(k) FILTER (label = 'A') AS a FROM k GROUP BY 1""")
def factor_maps(pts):
    m = records.factor_map(pts, "pattern_id", "label", F.count(F.lit(1)))
    return m.select("pattern_id", F.array_join(F.transform(F.map_entries("factors"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("factors"), F.col("factors")["A"].alias("a"))


@table_query(f"SELECT event_type, count(*) AS documents, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS total, max((props::JSON ->> 'k')::BIGINT) AS most, {q('avg((props::JSON ->> chr(107))::BIGINT)')} AS mean FROM events GROUP BY 1")
def request_documents(t):
    d = t("events").select("event_type", records.strict_json(F.col("props"), "k long").alias("d"))
    return d.groupBy("event_type").agg(F.count("d").alias("documents"), F.sum("d.k").alias("total"), F.max("d.k").alias("most"), F.avg("d.k").alias("mean"))


@table_query("""SELECT o_orderkey::BIGINT AS id, sha256(concat(strlen(o_orderkey::VARCHAR)::VARCHAR, ':', o_orderkey::VARCHAR, strlen(o_orderpriority)::VARCHAR, ':', o_orderpriority, CASE WHEN o_custkey % 7 = 0 THEN '-1:' ELSE concat(strlen(o_orderstatus)::VARCHAR, ':', o_orderstatus) END)) AS digest FROM orders""")
def content_digests(t):
    o = t("orders")
    return o.select(F.col("o_orderkey").cast("long").alias("id"), records.content_digest(F.col("o_orderkey"), F.col("o_orderpriority"), F.when(F.col("o_custkey") % 7 != 0, F.col("o_orderstatus"))).alias("digest"))


@query(f"""WITH {PTS}, {_MODES}, cp AS (SELECT pattern_id, -1 AS part, x, y, mark FROM pts UNION ALL SELECT l_suppkey::BIGINT, l_linenumber::INT, ((l_partkey * 37 + l_orderkey * 17) % 1000)::DOUBLE, ((l_orderkey * 61 + l_linenumber * 211 + l_partkey * 7) % 1000)::DOUBLE, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END FROM lineitem),
    m AS (SELECT pattern_id, part, avg(mark) AS p, count(*) AS n FROM cp GROUP BY 1, 2), f AS (SELECT c.pattern_id, part, mx, my, any_value(k) AS k, (pow(sum((mark - p) * cos(kx * x + ky * y)), 2) + pow(sum((mark - p) * sin(kx * x + ky * y)), 2)) / any_value(n) AS power FROM cp c JOIN m USING (pattern_id, part), md GROUP BY 1, 2, 3, 4)
    SELECT pattern_id, part, least(floor((k - 0.006) / (0.012 / 2)), 1)::INT AS shell, count(*) AS modes, {q('avg(power)')} AS power FROM f WHERE k <= 0.018 GROUP BY 1, 2, 3""")
def component_spectra(pts):
    parts = records.with_components(pts, "component").withColumn("both", F.col("pattern_id") * 100 + F.col("part"))
    waves = models.wave_numbers(pts.sparkSession, 1000.0, 0.006, 0.045).where("k <= 0.018")
    power = models.shell_means(models.structure_factor(parts.drop("pattern_id").withColumnRenamed("both", "pattern_id"), waves), 0.006, 0.018, 2)
    part = F.pmod(F.col("pattern_id") + 1, F.lit(100)) - 1
    return power.select(((F.col("pattern_id") - part) / 100).cast("long").alias("pattern_id"), part.cast("int").alias("part"), "shell", "modes", "power")


def _block(name: str, within: str, seed: int) -> str:
    return f"""{shuffle(name, 'pts', within, 'idx', 'mark', 99, seed)}, {name}a AS (SELECT pattern_id, 0 AS replicate, idx, mark FROM pts UNION ALL SELECT pattern_id, replicate, idx, mark FROM {name}),
    {name}b AS (SELECT a.pattern_id, replicate, avg(a.mark) AS b, count(*) AS k FROM {name}a a JOIN pts p USING (pattern_id, idx) GROUP BY a.pattern_id, replicate, floor(p.x / 100), floor(p.y / 100)),
    {name}s AS (SELECT pattern_id, replicate, sum(k * (b - p) * (b - p)) / sum(k) / any_value(v) AS s FROM {name}b JOIN (SELECT pattern_id, avg(mark) AS p, var_pop(mark) AS v FROM pts GROUP BY 1) USING (pattern_id) WHERE v > 0 GROUP BY 1, 2),
    {name}r AS (SELECT n.pattern_id, o.s AS share, avg(n.s) AS mean, stddev_samp(n.s) AS sd, (1 + count(*) FILTER (n.s >= o.s - 1e-12)) / 100.0 AS p FROM {name}s n JOIN {name}s o ON n.pattern_id = o.pattern_id AND o.replicate = 0 WHERE n.replicate > 0 GROUP BY 1, 2)"""


@query(f"WITH {PTS}, {_block('bf', 'pattern_id', 81)} SELECT pattern_id, {q('share')} AS share, {q('mean')} AS mean, {q('sd')} AS sd, {q('p')} AS p, CASE WHEN pattern_id % 9 = 0 THEN 'suppressed: too_few_cells' WHEN p <= 0.2 THEN 'structure beyond the null' ELSE 'compatible with the null' END AS said FROM bfr")
def block_share_test(pts):
    r = records.block_share_null(pts, 100.0, 99, 81)
    return r.withColumn("said", records.interpretation(F.when(F.col("pattern_id") % 9 == 0, "too_few_cells").otherwise(""), F.col("p"), 0.2))


@query(f"""WITH {PTS}, {_block('bf', 'pattern_id', 81)}, {_block('bs', 'pattern_id, stratum', 82)} SELECT f.pattern_id, {q('f.p')} AS p_free, {q('s.p')} AS p_within,
    CASE WHEN s.sd <= 1e-12 THEN 'degenerate' WHEN f.p <= 0.2 AND s.p <= 0.2 THEN 'robust' WHEN f.p <= 0.2 THEN 'confounded' WHEN s.p <= 0.2 THEN 'masked' ELSE 'none' END AS conclusion FROM bfr f JOIN bsr s USING (pattern_id)""")
def null_sensitivity(pts):
    return records.null_sensitivity(records.block_share_null(pts, 100.0, 99, 81), records.block_share_null(pts, 100.0, 99, 82, "stratum"), 0.2)


@query(f"""WITH {PTS} SELECT pattern_id, floor(x / 250)::BIGINT AS patch, sum(mark)::BIGINT AS marked, sum(1 - mark)::BIGINT AS unmarked, {q('avg(value) FILTER (mark = 1) - avg(value) FILTER (mark = 0)')} AS difference, {q('avg(value) FILTER (mark = 1) / nullif(avg(value) FILTER (mark = 0), 0)')} AS ratio FROM pts GROUP BY 1, 2""")
def area_contrast(pts):
    return records.group_contrast(pts.withColumn("patch", F.floor(F.col("x") / 250)), ["pattern_id", "patch"], "mark", "value")


@query(f"""WITH {PTS}, s AS (SELECT pattern_id, {', '.join(f'avg({c}) FILTER (mark = 1) - avg({c}) FILTER (mark = 0) AS d{c}, covar_pop(mark, {c}) AS c{c}' for c in ('pa', 'pb', 'pc'))} FROM pts GROUP BY 1)
    SELECT pattern_id, {q('(dpa * dpa + dpb * dpb + dpc * dpc) / 3')} AS discrepancy, {q('(cpa * cpa + cpb * cpb + cpc * cpc) / 3')} AS energy FROM s""")
def embedding_mark_energies(pts):
    return records.embedding_mark_energies(pts, ["pa", "pb", "pc"], "mark")


@query(f"""WITH {PTS}, {PR}, k AS (SELECT pattern_id, il AS source, jl AS target, count(*) AS pairs, sum(ipa * jpa) AS mass FROM pr WHERE d2 <= 900 GROUP BY 1, 2, 3)
    SELECT pattern_id, source, target, pairs, {q('mass')} AS mass, {q('pairs / sum(pairs) OVER w')} AS share, CASE WHEN sum(mass) OVER w > 0 THEN {q('mass / sum(mass) OVER w')} END AS mass_share FROM k WINDOW w AS (PARTITION BY pattern_id, source)""")
def support_mixing(pts):
    return records.support_mixing(pts, 30.0, "label", "pa")


_LO = {c: f"CASE WHEN {{0}}.label = '{c}' THEN {{0}}.p ELSE greatest(0.0, 1 - 3 * {{0}}.p) END" for c in "ANR"}
_HI = {c: f"CASE WHEN {{0}}.label = '{c}' THEN {{0}}.p ELSE least({{0}}.p, 1 - {{0}}.p) END" for c in "ANR"}


@query(f"""WITH {PTS}, w AS (SELECT pattern_id, idx, x, y, label, 0.4 + value / 100 AS p FROM pts), n AS (SELECT a.pattern_id, a.label, a.p, b.label AS bl, b.p AS bp FROM w a JOIN w b ON a.pattern_id = b.pattern_id AND a.idx <> b.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900)
    """ + " UNION ALL ".join(f"SELECT pattern_id, count(*) AS pairs, '{a}' AS a, '{b}' AS b, {q(f'avg(({_LO[a].format(chr(110))}) * ({_LO[b].format(chr(110)).replace(chr(110) + ".label", "n.bl").replace(chr(110) + ".p", "n.bp")}))')} AS lower, {q(f'avg(({_HI[a].format(chr(110))}) * ({_HI[b].format(chr(110)).replace(chr(110) + ".label", "n.bl").replace(chr(110) + ".p", "n.bp")}))')} AS upper FROM n GROUP BY 1" for a in "ANR" for b in "ANR"))
def top1_mixing_bounds(pts):
    return records.top1_mixing_bounds(pts.withColumn("p", 0.4 + F.col("value") / 100), 30.0, ["A", "N", "R"], 4, "label", "p")


_RA = "ra AS (SELECT pattern_id, floor(x / 100)::INT AS gx, floor(y / 100)::INT AS gy, avg(mark) >= 0.5 AS side FROM pts GROUP BY 1, 2, 3)"


@query(f"""WITH {PTS}, {_RA}, f AS (SELECT pattern_id, side, gx + dx AS gx, gy + dz AS gy FROM ra, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) s(dx, dz)), s AS (SELECT f.pattern_id, f.side, 100.0 * count(*) FILTER (o.side <> f.side) AS shared, 100.0 * count(*) FILTER (o.side IS NULL) AS outer_ FROM f LEFT JOIN ra o USING (pattern_id, gx, gy) GROUP BY 1, 2)
    SELECT pattern_id, side, {q('shared')} AS shared, {q('outer_')} AS "outer", {q('shared / nullif(shared + outer_, 0)')} AS contact FROM s""")
def compartment_contact(pts):
    return records.compartment_contact(records.compartment_raster(pts, 100.0), 100.0)


@query(f"""WITH RECURSIVE {PTS}, {_RA}, c AS (SELECT pattern_id, side, gx, gy, gx * 100 + gy AS id FROM ra), e AS (SELECT a.pattern_id, a.side, a.id AS u, b.id AS v FROM c a JOIN c b ON a.pattern_id = b.pattern_id AND a.side = b.side AND abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1),
    re AS (SELECT pattern_id, side, id AS u, id AS v FROM c UNION SELECT r.pattern_id, r.side, r.u, e.v FROM re r JOIN e ON e.pattern_id = r.pattern_id AND e.side = r.side AND e.u = r.v),
    l AS (SELECT pattern_id, side, u, min(v) AS root FROM re GROUP BY 1, 2, 3), k AS (SELECT pattern_id, side, root, count(*) AS k FROM l GROUP BY 1, 2, 3), s AS (SELECT pattern_id, side, count(*) AS m, sum(k) AS n, max(k) AS top, ln(sum(k)) - sum(k * ln(k)) / sum(k) AS h FROM k GROUP BY 1, 2)
    SELECT pattern_id, side, m AS components, {q('n * 10000.0')} AS area, {q('top / n')} AS largest_share, {q('h')} AS entropy, {q('CASE WHEN m > 1 THEN h / ln(m) ELSE 0.0 END')} AS normalised FROM s""")
def compartment_fragments(pts):
    return records.compartment_fragments(records.compartment_raster(pts, 100.0), 100.0)


@table_query(f"""WITH u AS (SELECT o_orderpriority AS endpoint, (o_custkey % 8)::BIGINT AS unit, avg(o_totalprice)::DOUBLE / 1000 AS value FROM orders GROUP BY 1, 2), m AS (SELECT mask FROM (SELECT unnest(range(256)) AS mask) WHERE bit_count(mask) = 4),
    d AS (SELECT mask, endpoint, abs(avg(value) FILTER ((mask >> unit) & 1 = 1) - avg(value) FILTER ((mask >> unit) & 1 = 0)) AS d FROM u, m GROUP BY 1, 2), t AS (SELECT mask, max(d) AS m FROM d GROUP BY 1), o AS (SELECT endpoint, d AS s FROM d WHERE mask = 15)
    SELECT endpoint, {q('s')} AS statistic, count(*) AS labellings, {q('avg((m >= s - 1e-12)::INT)')} AS p_adjusted FROM o, t GROUP BY endpoint, s""")
def exact_max_t(t):
    rows = t("orders").groupBy(F.col("o_orderpriority").alias("endpoint"), (F.col("o_custkey") % 8).cast("long").alias("unit")).agg((F.avg("o_totalprice").cast("double") / 1000).alias("value"))
    return records.exact_max_t(rows, "endpoint", "unit", [0, 1, 2, 3])


@query(f"""WITH {PTS}, {PR}, {shuffle('st', 'pts', 'pattern_id', 'idx', 'mark', 39, 83)}, al AS (SELECT pattern_id, 0 AS replicate, idx, mark FROM pts UNION ALL SELECT pattern_id, replicate, idx, mark FROM st), nb AS (SELECT pattern_id, i, j FROM pr WHERE d2 <= 900),
    nr AS (SELECT n.pattern_id, a.replicate, n.i AS idx, max(a.mark) AS near FROM nb n JOIN al a ON a.pattern_id = n.pattern_id AND a.idx = n.j GROUP BY 1, 2, 3), un AS (SELECT a.pattern_id, a.replicate, p.value AS o, coalesce(near, 0) AS near FROM al a JOIN pts p USING (pattern_id, idx) LEFT JOIN nr USING (pattern_id, replicate, idx) WHERE a.mark = 0),
    e AS (SELECT pattern_id, replicate, count(*) FILTER (near = 1) AS exposed, count(*) FILTER (near = 0) AS isolated, avg(o) FILTER (near = 1) - avg(o) FILTER (near = 0) AS effect FROM un GROUP BY 1, 2), s AS (SELECT * FROM e WHERE replicate = 0)
    SELECT s.pattern_id, s.exposed, s.isolated, {q('s.effect')} AS effect, {q('(1 + count(*) FILTER (abs(e.effect) >= abs(s.effect) - 1e-12)) / 40.0')} AS p FROM s JOIN e ON e.pattern_id = s.pattern_id AND e.replicate > 0 GROUP BY s.pattern_id, s.exposed, s.isolated, s.effect""")
def interference_test(pts):
    return records.interference(pts, 30.0, 39, 83)


@query(f"WITH {PTS} SELECT pattern_id, count(*) AS n, {q('0.5 * ln(1 + count(*) * 4.0 / 225.0)')} AS gain, {q('1 / (1 / 4.0 + count(*) / 225.0)')} AS posterior_variance FROM pts GROUP BY 1")
def information_gain(pts):
    return records.information_gain(pts, "pattern_id", 4.0, 225.0)


@query(f"""WITH {PTS}, c AS (SELECT pattern_id, idx FROM (SELECT DISTINCT pattern_id FROM pts), (SELECT unnest(range(50)) AS idx)) SELECT pattern_id, idx, idx * 12.0::DOUBLE AS x, 0.0::DOUBLE AS y, (row_number() OVER ({_P} ORDER BY {draw(84, 'pattern_id', 'idx')}, idx) <= 15)::INT AS mark FROM c""")
def random_labels(pts):
    return records.random_labels(pts, 50, 0.3, 12.0, 84)


@query(f"""WITH {PTS}, {PR}, w AS (SELECT pattern_id, {', '.join(f'sum(exp(-0.5 * pow((sqrt(d2) - {c}) / 4, 2))) AS w{k}' for k, c in enumerate((10.0, 20.0, 30.0)))} FROM pr WHERE i < j AND d2 <= 1764 GROUP BY 1),
    b AS (SELECT pattern_id, 0 AS bin, w0 AS w FROM w UNION ALL SELECT pattern_id, 1, w1 FROM w UNION ALL SELECT pattern_id, 2, w2 FROM w), t AS (SELECT bin, avg(w) AS target FROM b GROUP BY 1) SELECT pattern_id, {q('avg(pow((w - target) / target, 2))')} AS loss FROM b JOIN t USING (bin) GROUP BY 1""")
def summary_matching(pts):
    s = records.soft_pair_histogram(pts, [10.0, 20.0, 30.0], 4.0)
    return records.matching_loss(s, s.groupBy("bin").agg(F.avg("weight").alias("target")))


@query(f"""WITH {PTS}, {PR}, n AS (SELECT pattern_id, count(*) AS n FROM pts GROUP BY 1), s AS (SELECT pattern_id, replicate, unnest(range(n)) AS idx FROM n, (SELECT unnest(range(1, 40)) AS replicate)), p AS (SELECT *, 1000 * {unit(85, 'pattern_id', 'replicate', 'idx')} AS x, 1000 * {unit(86, 'pattern_id', 'replicate', 'idx')} AS y FROM s),
    c AS (SELECT *, floor(x / 15)::INT AS gx, floor(y / 15)::INT AS gy FROM p), o AS (SELECT pattern_id, replicate, idx, x, y, gx + dx AS gx, gy + dz AS gy FROM c, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dz)),
    k0 AS (SELECT a.pattern_id, a.replicate, count(*) AS k FROM c a JOIN o b USING (pattern_id, replicate, gx, gy) WHERE a.idx < b.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 225 GROUP BY 1, 2), k AS (SELECT pattern_id, replicate, coalesce(k, 0) AS k FROM n CROSS JOIN (SELECT unnest(range(1, 40)) AS replicate) LEFT JOIN k0 USING (pattern_id, replicate)),
    ob AS (SELECT pattern_id, coalesce(ob, 0) AS observed FROM n LEFT JOIN (SELECT pattern_id, count(*) AS ob FROM pr WHERE i < j AND d2 <= 225 GROUP BY 1) USING (pattern_id)), r AS (SELECT *, row_number() OVER ({_P} ORDER BY k, replicate) AS r FROM k JOIN ob USING (pattern_id))
    SELECT pattern_id, observed, {q('avg(k)')} AS mean, max(k) FILTER (r = 1) AS low, max(k) FILTER (r = 39) AS high, {q('(1 + count(*) FILTER (k >= observed)) / 40.0')} AS p_high FROM r GROUP BY 1, 2""")
def close_pair_check(pts):
    return records.close_pair_check(pts, 15.0, WINDOW, 39, 85)


@table_query(f"""WITH {_SC}, c AS (SELECT lang, label::DOUBLE AS y, score, greatest(1e-6, least(1 - 1e-6, score)) AS p FROM s) SELECT lang, count(*) AS n, {q('avg(-(y * ln(p) + (1 - y) * ln(1 - p)))')} AS log_loss, {q('avg((score - y) * (score - y))')} AS brier, {q('avg(y) - avg(score)')} AS in_the_large, {q('regr_slope(y, score)')} AS slope FROM c GROUP BY 1""")
def prediction_calibration(t):
    return records.calibration(_scores(t), "lang")


@table_query(f"""WITH d AS (SELECT event_type, (event_id % 4)::BIGINT AS chain, event_id, value, ntile(2) OVER (PARTITION BY event_type, event_id % 4 ORDER BY event_id) AS half FROM events), l AS (SELECT *, lag(value) OVER (PARTITION BY event_type, chain, half ORDER BY event_id) AS before FROM d),
    c AS (SELECT event_type, chain, half, count(*) AS n, avg(value) AS m, var_samp(value) AS v, corr(value, before) AS r FROM l GROUP BY 1, 2, 3), s AS (SELECT event_type, sum(n)::BIGINT AS draws, avg(n) AS n, avg(v) AS w, var_samp(m) AS b, avg(r) AS r FROM c GROUP BY 1),
    f AS (SELECT event_type, draws, sqrt(((n - 1) / n * w + b) / w) AS rh, least(draws, draws * (1 - r) / (1 + r)) AS es FROM s) SELECT event_type, draws, {q('rh')} AS r_hat, {q('es', 3)} AS effective, rh <= 1.01 AND es >= 400 AS passed FROM f""")
def draw_diagnostics(t):
    e = t("events").select("event_type", (F.col("event_id") % 4).cast("long").alias("chain"), "event_id", F.col("value").cast("double").alias("value"))
    return records.draw_diagnostics(e, "event_type", "chain", "event_id", "value", 1.01, 400).withColumn("effective", F.round(F.col("effective") + 3.7e-9, 3))


@query(f"""WITH {PTS}, {PR}, m AS (SELECT pattern_id, avg(value) AS m FROM pts GROUP BY 1), g AS (SELECT pattern_id, i, count(*) AS d, any_value(iv) - any_value(m) AS f, sum(jv - m) AS s FROM pr JOIN m USING (pattern_id) WHERE d2 <= 900 GROUP BY 1, 2)
    SELECT pattern_id, sum(d)::BIGINT AS links, {q('sum(d * f * f - 0.9 * f * s)', 4)} AS form, {q('corr(f, s / d)')} AS lag_correlation FROM g GROUP BY 1""")
def autoregressive_form(pts):
    return records.autoregressive_form(pts, 30.0, 0.9).withColumn("form", F.round(F.col("form") + 3.7e-9, 4))


_FLAGS = ("provenance_complete", "converged", "severe_failure", "approximate", "error_validated", "clinical_claim", "externally_validated", "causal_claim", "identified", "bayesian", "calibrated", "predictive_checked")
_RULES = (
    ("NOT provenance_complete", 5, "provenance_incomplete"), ("NOT converged", 5, "nonconverged"), ("severe_failure", 5, "severe_diagnostic_failure"), ("approximate AND NOT error_validated", 4, "approximate_mode_without_validated_error_or_calibration"),
    ("clinical_claim AND NOT externally_validated", 3, "predictive_clinical_claim_without_external_validation"), ("causal_claim AND NOT identified", 5, "causal_identification_unsupported"), ("bayesian AND NOT (calibrated AND predictive_checked)", 3, "bayesian_requirements_incomplete"),
)
_RANKS = ", ".join(f"'{m}'" for m in workflow.MATURITY)


@table_query(f"""WITH s AS (SELECT o_orderkey::BIGINT AS id, [{_RANKS}][o_orderkey % 5 + 1] AS method, {', '.join(f'(o_custkey >> {k}) & 1 = {int(k < 2)} AS {f}' for k, f in enumerate(_FLAGS))} FROM orders),
    r AS (SELECT id, method, greatest(list_position([{_RANKS}], method), {', '.join(f'CASE WHEN {t} THEN {n} ELSE 0 END' for t, n, _ in _RULES)}) AS k, concat_ws(',', {', '.join(f"CASE WHEN {t} THEN '{w}' END" for t, _, w in _RULES)}) AS reasons FROM s)
    SELECT id, method, [{_RANKS}][k] AS maturity, [{_RANKS}][k] <> method AS downgraded, reasons FROM r""")
def result_maturity(t):
    o, bit = t("orders"), lambda k: F.shiftright("o_custkey", k).bitwiseAND(F.lit(1)) == int(k < 2)
    method = F.element_at(F.array(*map(F.lit, workflow.MATURITY)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    spec = o.select(F.col("o_orderkey").cast("long").alias("id"), method.alias("method"), *[bit(k).alias(f) for k, f in enumerate(_FLAGS)])
    return workflow.result_maturity(spec).select("id", "method", "maturity", "downgraded", "reasons")
