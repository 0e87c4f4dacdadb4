"""Corrected cross curves, intensity fits, permutation nulls and windows, as queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import nulls
from .more_queries import _H, _ISO, _KER, _RG, _RGS
from .queries import _OV, AREA, BI, PR, PTS, WINDOW, B, q, query, shuffle, table_query, unit


@query(f"""WITH {PTS}, {PR}, {_RGS}, t AS (SELECT pattern_id, count(*) FILTER (label = 'R') AS sources, count(*) FILTER (label = 'A') AS targets FROM pts GROUP BY 1 HAVING count(*) FILTER (label = 'R') > 0 AND count(*) FILTER (label = 'A') > 0),
    w AS (SELECT pattern_id, r, sum({_KER} * {AREA} / {_OV}) AS wt, sum({_KER} * {_ISO}) AS ws FROM pr, rs WHERE il = 'R' AND jl = 'A' AND abs(r - sqrt(d2)) < 10 GROUP BY 1, 2)
    SELECT pattern_id, r, sources, targets, {q(f'{AREA} * coalesce(wt, 0) / (2 * pi() * r * sources * targets)')} AS translation, {q(f'{AREA} * coalesce(ws, 0) / (2 * pi() * r * sources * targets)')} AS isotropic FROM t CROSS JOIN rs LEFT JOIN w USING (pattern_id, r)""")
def corrected_cross_pair_correlation(pts):
    return nulls.corrected_cross_g(pts, "R", "A", _RG, _H, WINDOW)


@query(f"""WITH {PTS}, {PR}, {_RGS}, lm AS (SELECT pattern_id, idx, label, x, y, count(*) OVER (PARTITION BY pattern_id, label, x < 500) / 500000.0 AS lam FROM pts), lo AS (SELECT pattern_id, r, sum(1 / lam) AS low, count(*) AS eligible FROM lm, rs WHERE label = 'R' AND {B} >= r + 10 GROUP BY 1, 2),
    tp AS (SELECT p.pattern_id, r, sum({_KER} / (a.lam * b.lam)) AS top FROM pr p JOIN lm a ON a.pattern_id = p.pattern_id AND a.idx = p.i JOIN lm b ON b.pattern_id = p.pattern_id AND b.idx = p.j, rs WHERE il = 'R' AND jl = 'A' AND abs(r - sqrt(d2)) < 10 AND r + 10 <= {BI} GROUP BY 1, 2)
    SELECT pattern_id, r, eligible, {q('coalesce(top, 0) / low / (2 * pi() * r)')} AS g FROM lo LEFT JOIN tp USING (pattern_id, r)""")
def inhomogeneous_cross_pair_correlation(pts):
    rich = pts.withColumn("side", F.col("x") < 500)
    return nulls.inhomogeneous_cross_g(rich, "R", "A", F.count(F.lit(1)).over(Window.partitionBy("pattern_id", "label", "side")) / 500000.0, _RG, _H, WINDOW)


@query(f"""WITH {PTS}, g AS (SELECT pattern_id, a.v AS gx, b.v AS gy, a.v * 10 + b.v AS cell, coalesce(k, 0) + 0.5 AS w FROM (SELECT DISTINCT pattern_id FROM pts) CROSS JOIN (SELECT unnest(range(10)) AS v) a CROSS JOIN (SELECT unnest(range(10)) AS v) b LEFT JOIN (SELECT pattern_id, floor(x / 100)::INT AS cx, floor(y / 100)::INT AS cy, count(*) AS k FROM pts GROUP BY 1, 2, 3) USING (pattern_id) WHERE cx = a.v AND cy = b.v OR cx IS NULL),
    h AS (SELECT *, sum(w) OVER (PARTITION BY pattern_id ORDER BY cell) / sum(w) OVER (PARTITION BY pattern_id) AS hi FROM g), l AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY pattern_id ORDER BY cell), 0) AS lo FROM h),
    n AS (SELECT pattern_id, unnest(range(count(*))) AS idx FROM pts GROUP BY 1), u AS (SELECT *, {unit(93, 'pattern_id', 'idx')} AS u FROM n)
    SELECT u.pattern_id, idx, cell, {q(f"gx * 100 + 100 * {unit(94, 'u.pattern_id', 'idx')}")} AS x, {q(f"gy * 100 + 100 * {unit(95, 'u.pattern_id', 'idx')}")} AS y FROM u JOIN l ON l.pattern_id = u.pattern_id AND u.u >= lo AND (u.u < hi OR hi >= 1 - 1e-12)""")
def grid_intensity_sample(pts):
    cell = lambda c: F.floor(F.col(c) / 100).cast("int")
    k = pts.groupBy("pattern_id", cell("x").alias("gx"), cell("y").alias("gy")).agg(F.count(F.lit(1)).alias("k"))
    line = F.explode(F.sequence(F.lit(0), F.lit(9)))
    full = pts.select("pattern_id").distinct().withColumn("gx", line).withColumn("gy", line).join(k, ["pattern_id", "gx", "gy"])
    w = full.select("pattern_id", (F.col("gx") * 10 + F.col("gy")).cast("long").alias("cell"), (F.col("gx") * 100.0).alias("cx"), (F.col("gy") * 100.0).alias("cy"), (F.col("k") + 0.5).alias("w"))
    return nulls.grid_sample(w, pts.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n")), 100.0, 93)


_CH = [("value", "value", "v"), ("mark", "mark", "m"), ("constant", "1.0", "c")]


@query(f"""WITH {PTS}, {PR}, ch AS (SELECT pattern_id, idx, 'value' AS channel, value::DOUBLE AS v FROM pts UNION ALL SELECT pattern_id, idx, 'mark', mark FROM pts UNION ALL SELECT pattern_id, idx, 'constant', 1.0 FROM pts), m AS (SELECT pattern_id, channel, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM ch GROUP BY 1, 2),
    e AS (SELECT p.pattern_id, a.channel, count(*) AS edges, sum((a.v - m.m) * (b.v - m.m)) AS c, sum((a.v - b.v) * (a.v - b.v)) AS d FROM pr p JOIN ch a ON a.pattern_id = p.pattern_id AND a.idx = p.i JOIN ch b ON b.pattern_id = p.pattern_id AND b.idx = p.j AND b.channel = a.channel JOIN m ON m.pattern_id = p.pattern_id AND m.channel = a.channel WHERE d2 <= 900 GROUP BY 1, 2)
    SELECT pattern_id, channel, n, coalesce(edges, 0) AS edges, CASE WHEN n >= 20 AND ss > 1e-9 AND edges > 0 THEN {q('n / edges * c / ss')} END AS moran_i, CASE WHEN n >= 20 AND ss > 1e-9 AND edges > 0 THEN {q('(n - 1) / (2.0 * edges) * d / ss')} END AS geary_c,
      CASE WHEN n < 20 THEN 'too_few_cells' WHEN ss <= 1e-9 THEN 'constant_channel' WHEN edges IS NULL THEN 'no_neighbours' ELSE 'available' END AS status FROM m LEFT JOIN e USING (pattern_id, channel)""")
def assay_summary(pts):
    return nulls.assay_summary(pts.withColumn("constant", F.lit(1.0)), 30.0, ["value", "mark", "constant"], 20)


def _local(within: str, seed: int) -> str:
    return f"""WITH {PTS}, {PR}, zz AS (SELECT pattern_id, stratum, idx, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM pts WINDOW w AS (PARTITION BY pattern_id)), {shuffle('sz', 'zz', within, 'idx', 'z', 39, seed)},
    al AS (SELECT pattern_id, 0 AS replicate, idx, z FROM zz UNION ALL SELECT pattern_id, replicate, idx, z FROM sz), lg AS (SELECT p.pattern_id, a.replicate, p.i AS idx, avg(a.z) AS lag FROM pr p JOIN al a ON a.pattern_id = p.pattern_id AND a.idx = p.j WHERE d2 <= 900 GROUP BY 1, 2, 3),
    lo AS (SELECT pattern_id, replicate, idx, z * lag AS i FROM lg JOIN al USING (pattern_id, replicate, idx)), tp AS (SELECT pattern_id, replicate, max(abs(i)) AS m FROM lo WHERE replicate > 0 GROUP BY 1, 2)
    SELECT l.pattern_id, l.idx, {q('l.i')} AS local_i, {q('(1 + count(*) FILTER (m >= abs(l.i) - 1e-12)) / 40.0')} AS p_adjusted FROM lo l JOIN tp USING (pattern_id) WHERE l.replicate = 0 GROUP BY l.pattern_id, l.idx, l.i"""


@query(_local("pattern_id", 96))
def local_moran_max_t(pts):
    return nulls.local_moran_max_t(pts, 30.0, 39, 96)


@query(_local("pattern_id, stratum", 97))
def stratified_hotspots(pts):
    return nulls.local_moran_max_t(pts, 30.0, 39, 97, stratum="stratum")


_XL = "CASE WHEN {0} > 0 THEN ({0}) * ln(({0}) / ({1})::DOUBLE) ELSE 0.0 END"
_LLR = " + ".join(_XL.format(a, b) for a, b in (("mi", "ni"), ("(ni - mi)", "ni"), ("(m - mi)", "(n - ni)"), ("((n - ni) - (m - mi))", "(n - ni)"))) + " - " + " - ".join(_XL.format(a, "n") for a in ("m", "(n - m)"))


@query(f"""WITH {PTS}, {PR}, {shuffle('sm', 'pts', 'pattern_id', 'idx', 'mark', 39, 98)}, al AS (SELECT pattern_id, 0 AS replicate, idx, mark FROM pts UNION ALL SELECT pattern_id, replicate, idx, mark FROM sm), pa AS (SELECT pattern_id, i, j FROM pr WHERE d2 <= 900 UNION ALL SELECT pattern_id, idx, idx FROM pts),
    ds AS (SELECT p.pattern_id, a.replicate, p.i, count(*) AS ni, sum(a.mark) AS mi FROM pa p JOIN al a ON a.pattern_id = p.pattern_id AND a.idx = p.j GROUP BY 1, 2, 3), dt AS (SELECT * FROM ds JOIN (SELECT pattern_id, count(*) AS n, sum(mark) AS m FROM pts GROUP BY 1) USING (pattern_id) WHERE ni >= 2 AND ni <= n / 2 AND n - ni >= 2),
    lr AS (SELECT pattern_id, replicate, i, ni, mi, round(CASE WHEN mi * (n - ni) > (m - mi) * ni THEN {_LLR} ELSE 0.0 END, 9) AS llr FROM dt), be AS (SELECT * FROM lr QUALIFY row_number() OVER (PARTITION BY pattern_id, replicate ORDER BY llr DESC, i) = 1)
    SELECT o.pattern_id, o.i AS centre, {q('o.llr')} AS llr, o.ni::BIGINT AS inside, o.mi::BIGINT AS marked, {q('(1 + count(*) FILTER (b.llr >= o.llr)) / 40.0')} AS p FROM be o JOIN be b ON b.pattern_id = o.pattern_id AND b.replicate > 0 WHERE o.replicate = 0 GROUP BY o.pattern_id, o.i, o.llr, o.ni, o.mi""")
def scan_permutation(pts):
    return nulls.scan_permutation(pts, 30.0, 39, 98)


@query(f"""WITH {PTS}, {PR}, ed AS MATERIALIZED (SELECT pattern_id, i, j FROM pr WHERE i < j AND d2 <= 900), we AS MATERIALIZED (SELECT a.pattern_id, a.i, a.j, b.j AS k FROM ed a JOIN ed b ON a.pattern_id = b.pattern_id AND a.j = b.i), tr AS MATERIALIZED (SELECT w.* FROM we w SEMI JOIN ed c ON c.pattern_id = w.pattern_id AND c.i = w.i AND c.j = w.k),
    cd AS (SELECT label, row_number() OVER (ORDER BY label)::TINYINT AS c FROM (SELECT DISTINCT label FROM pts)), {shuffle('sl', 'pts', 'pattern_id', 'idx', 'label', 39, 99)}, al AS (SELECT pattern_id, 0 AS replicate, idx, label FROM pts UNION ALL SELECT pattern_id, replicate, idx, label FROM sl),
    ls AS MATERIALIZED (SELECT pattern_id, idx, list(c ORDER BY replicate) AS ls FROM al JOIN cd USING (label) GROUP BY 1, 2),
    un AS MATERIALIZED (SELECT t.pattern_id, unnest(range(40)) AS replicate, unnest(a.ls)::INT AS a, unnest(b.ls)::INT AS b, unnest(c.ls)::INT AS c FROM tr t JOIN ls a ON a.pattern_id = t.pattern_id AND a.idx = t.i JOIN ls b ON b.pattern_id = t.pattern_id AND b.idx = t.j JOIN ls c ON c.pattern_id = t.pattern_id AND c.idx = t.k),
    cn AS MATERIALIZED (SELECT pattern_id, replicate, least(a, b, c) AS lo, a + b + c - least(a, b, c) - greatest(a, b, c) AS mi, greatest(a, b, c) AS hi, count(*) AS k FROM un GROUP BY ALL),
    ct AS MATERIALIZED (SELECT pattern_id, replicate, concat_ws('-', x.label, y.label, z.label) AS motif, k FROM cn JOIN cd x ON x.c = lo JOIN cd y ON y.c = mi JOIN cd z ON z.c = hi),
    fl AS (SELECT pattern_id, motif, replicate, coalesce(k, 0) AS k FROM (SELECT DISTINCT pattern_id, motif FROM ct) CROSS JOIN (SELECT unnest(range(40)) AS replicate) LEFT JOIN ct USING (pattern_id, motif, replicate)),
    s AS (SELECT f.pattern_id, f.motif, o.k AS triangles, avg(f.k) AS m, stddev_samp(f.k) AS sd, (1 + count(*) FILTER (f.k >= o.k)) / 40.0 AS p FROM fl f JOIN fl o ON o.pattern_id = f.pattern_id AND o.motif = f.motif AND o.replicate = 0 WHERE f.replicate > 0 GROUP BY 1, 2, 3)
    SELECT pattern_id, motif, triangles, {q('m')} AS mean, CASE WHEN sd > 0 THEN {q('(triangles - m) / sd')} END AS z, {q('p')} AS p_high FROM s""")
def motif_null(pts):
    return nulls.motif_null(pts, 30.0, 39, 99)


@query(f"""WITH {PTS}, {PR}, rs AS (SELECT unnest([15.0, 30.0, 50.0])::DOUBLE AS r), n AS (SELECT pattern_id, count(*) AS n FROM pts GROUP BY 1), w AS (SELECT pattern_id, r, sum(2 * 1e18 / ((1000 - abs(ix - jx)) * (1000 - abs(iy - jy)) * (1000 - abs(iz - jz)))) AS w FROM pr, rs WHERE i < j AND d2 + 0.25 * (iz - jz) * (iz - jz) <= r * r GROUP BY 1, 2)
    SELECT pattern_id, r, n, CASE WHEN n > 1 THEN {q('coalesce(w, 0) / (n * (n - 1))', 3)} END AS k FROM n CROSS JOIN rs LEFT JOIN w USING (pattern_id, r)""")
def translation_k3d(pts):
    return nulls.translation_k3d(pts, [15.0, 30.0, 50.0], (1000.0, 1000.0, 1000.0), (1.0, 1.0, 0.5)).withColumn("k", F.round(F.col("k") + 3.7e-9, 3))


_PF = "u AS (SELECT o_orderpriority AS family, (o_custkey % 40)::BIGINT AS unit, o_custkey % 40 < 18 AS g, count(*)::DOUBLE AS a, avg(o_totalprice)::DOUBLE / 10000 AS b FROM orders GROUP BY 1, 2, 3)"


@table_query(f"""WITH {_PF}, {shuffle('sg', 'u', 'family', 'unit', 'g', 99, 111)}, al AS (SELECT family, 0 AS replicate, unit, g FROM u UNION ALL SELECT family, replicate, unit, g FROM sg), k AS (SELECT x.family, x.unit AS i, y.unit AS j, exp(-((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) / 50.0) AS k FROM u x JOIN u y ON x.family = y.family AND x.unit < y.unit),
    s AS (SELECT k.family, p.replicate, sum(CASE WHEN p.g AND r.g THEN k ELSE 0 END) AS a, sum(CASE WHEN NOT p.g AND NOT r.g THEN k ELSE 0 END) AS b, sum(CASE WHEN p.g <> r.g THEN k ELSE 0 END) AS c FROM k JOIN al p ON p.family = k.family AND p.unit = k.i JOIN al r ON r.family = k.family AND r.unit = k.j AND r.replicate = p.replicate GROUP BY 1, 2),
    z AS (SELECT family, count(*) AS units, count(*) FILTER (g) AS m, count(*) FILTER (NOT g) AS l FROM u GROUP BY 1), v AS (SELECT family, replicate, units, 2 * a / (m * (m - 1)) + 2 * b / (l * (l - 1)) - 2 * c / (m * l) AS v FROM s JOIN z USING (family))
    SELECT o.family, o.units, {q('o.v')} AS mmd, {q('(1 + count(*) FILTER (v.v >= o.v - 1e-12)) / 100.0')} AS p FROM v o JOIN v ON v.family = o.family AND v.replicate > 0 WHERE o.replicate = 0 GROUP BY o.family, o.units, o.v""")
def kernel_mmd(t):
    u = t("orders").groupBy(F.col("o_orderpriority").alias("family"), (F.col("o_custkey") % 40).cast("long").alias("unit")).agg(F.count(F.lit(1)).cast("double").alias("a"), (F.avg("o_totalprice").cast("double") / 10000).alias("b"))
    return nulls.kernel_mmd(u.withColumn("g", F.col("unit") < 18), "family", "unit", "g", ["a", "b"], 5.0, 99, 111)


@query(f"""WITH {PTS}, r AS (SELECT pattern_id, avg(value) AS ma, avg(z) AS mb, var_samp(value) AS va, var_samp(z) AS vb, covar_samp(value, z) AS c FROM pts WHERE stratum = 'F' GROUP BY 1), d AS (SELECT pattern_id, idx, CASE WHEN va * vb - c * c > 1e-12 THEN ((value - ma) * (value - ma) * vb - 2 * (value - ma) * (z - mb) * c + (z - mb) * (z - mb) * va) / (va * vb - c * c) END AS d FROM pts JOIN r USING (pattern_id))
    SELECT pattern_id, idx, {q('d')} AS distance, d > 4.0 AS outside FROM d""")
def mahalanobis_distance(pts):
    return nulls.mahalanobis(pts, "pattern_id", ("value", "z"), F.col("stratum") == "F", 4.0)


def _snip(rounds: int) -> str:
    out = "SELECT event_type, mz, v, v AS b FROM p"
    for k in range(1, rounds + 1):
        out = f"SELECT event_type, mz, v, least(b, coalesce((lag(b, {k}) OVER w + lead(b, {k}) OVER w) / 2, b)) AS b FROM ({out}) WINDOW w AS (PARTITION BY event_type ORDER BY mz)"
    return out


@table_query(f"WITH p AS (SELECT event_type, event_id % 1000 AS mz, sum(abs(value))::DOUBLE AS v FROM events GROUP BY 1, 2) SELECT event_type, mz, {q('b')} AS baseline, {q('v - b')} AS corrected FROM ({_snip(5)})")
def snip_baseline(t):
    peaks = t("events").groupBy("event_type", (F.col("event_id") % 1000).alias("mz")).agg(F.sum(F.abs("value")).alias("i"))
    return nulls.snip_baseline(peaks, 5, "event_type", "mz", "i")


@query(f"""WITH {PTS}, c AS (SELECT pattern_id, floor(x / 50)::BIGINT AS bin, avg(value) AS v FROM pts GROUP BY 1, 2) SELECT pattern_id, bin, {q('v')} AS v, CASE WHEN count(v) OVER w = 5 THEN {q('quantile_cont(v, 0.9) OVER w')} END AS rolled FROM c WINDOW w AS (PARTITION BY pattern_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def rolling_quantile(pts):
    return nulls.rolling_quantile(pts.groupBy("pattern_id", F.floor(F.col("x") / 50).alias("bin")).agg(F.avg("value").alias("v")), 5, 0.9, "pattern_id", "bin", "v")


@query(f"""WITH RECURSIVE {PTS}, c AS MATERIALIZED (SELECT pattern_id, gx, gy, (gx + 0.5) / 10 AS x, coalesce(k, 0)::DOUBLE AS k FROM (SELECT DISTINCT pattern_id FROM pts) CROSS JOIN (SELECT unnest(range(10))::INT AS gx) CROSS JOIN (SELECT unnest(range(10))::INT AS gy) LEFT JOIN (SELECT pattern_id, floor(x / 100)::INT AS gx, floor(y / 100)::INT AS gy, count(*) AS k FROM pts GROUP BY 1, 2, 3) USING (pattern_id, gx, gy)),
    f AS (SELECT pattern_id, ln(avg(k) / 10000.0) AS a, 0.0::DOUBLE AS b, 0 AS n FROM c GROUP BY 1 HAVING sum(k) > 0 UNION ALL SELECT pattern_id, a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1), b + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1), n + 1
      FROM (SELECT f.pattern_id, f.a, f.b, f.n, sum(k - m) AS g0, sum((k - m) * x) AS g1, sum(m) AS h0, sum(m * x) AS h1, sum(m * x * x) AS h2 FROM (SELECT f.pattern_id, f.a, f.b, f.n, c.k, c.x, 10000.0 * exp(f.a + f.b * c.x) AS m FROM f JOIN c ON c.pattern_id = f.pattern_id WHERE f.n < 8) f GROUP BY 1, 2, 3, 4)),
    m AS (SELECT f.pattern_id, a, b, k, 10000.0 * exp(a + b * x) AS m FROM f JOIN c USING (pattern_id) WHERE n = 8) SELECT pattern_id, {q('a')} AS a, {q('b')} AS b, {q('sum(k * ln(m) - m)', 4)} AS log_likelihood, {q('2 * sum(CASE WHEN k > 0 THEN k * ln(k / m) ELSE 0 END - (k - m))', 4)} AS deviance FROM m GROUP BY pattern_id, a, b""")
def poisson_intensity_fit(pts):
    cell = lambda c: F.floor(F.col(c) / 100).cast("int")
    k = pts.groupBy("pattern_id", cell("x").alias("gx"), cell("y").alias("gy")).agg(F.count(F.lit(1)).alias("k"))
    line = F.explode(F.sequence(F.lit(0), F.lit(9)))
    cells = pts.select("pattern_id").distinct().withColumn("gx", line).withColumn("gy", line).join(k, ["pattern_id", "gx", "gy"], "left").fillna(0, ["k"])
    fit = nulls.poisson_fit(cells.withColumn("u", (F.col("gx") + 0.5) / 10), "pattern_id", "k", "u", 10000.0)
    return fit.withColumns({c: F.round(F.col(c) + 3.7e-9, 4) for c in ("log_likelihood", "deviance")})


@table_query(f"""WITH u AS (SELECT n_regionkey::INT AS site, n_nationkey::BIGINT AS unit, CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS label FROM nation), {shuffle('sg', 'u', 'site', 'unit', 'label', 20, 112)} SELECT site, replicate, unit, label FROM sg""")
def label_schedules(t):
    n = t("nation").select(F.col("n_regionkey").cast("int").alias("site"), F.col("n_nationkey").cast("long").alias("unit"), F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b").alias("label"))
    return nulls.label_schedules(n, "site", "unit", "label", 20, 112).withColumn("replicate", F.col("replicate").cast("long"))


@table_query(f"""WITH c AS (SELECT o_orderpriority AS family, (o_custkey % 40)::BIGINT AS unit, quarter(o_orderdate)::INT AS axis, (o_custkey % 40 < 18)::INT AS g, avg(o_totalprice)::DOUBLE / 1000 AS v FROM orders GROUP BY 1, 2, 3, 4), u AS (SELECT *, row_number() OVER (PARTITION BY family, g ORDER BY unit) - 1 AS k, count(*) OVER (PARTITION BY family, g) AS m FROM (SELECT DISTINCT family, unit, g FROM c)),
    d AS (SELECT family, g, replicate, floor({unit(113, 'replicate', 'family', 'unit')} * m)::BIGINT AS k FROM u, (SELECT unnest(range(1, 200)) AS replicate)), p AS (SELECT d.family, d.replicate, d.g, c.axis, c.v FROM d JOIN u ON u.family = d.family AND u.g = d.g AND u.k = d.k JOIN c ON c.family = d.family AND c.unit = u.unit),
    n AS (SELECT family, axis, replicate, avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0) AS d FROM p GROUP BY 1, 2, 3), b AS (SELECT family, axis, quantile_cont(d, 0.05) AS low, quantile_cont(d, 0.95) AS high FROM n GROUP BY 1, 2), s AS (SELECT family, axis, avg(v) FILTER (g = 1) - avg(v) FILTER (g = 0) AS d FROM c GROUP BY 1, 2)
    SELECT family, axis, {q('d')} AS difference, {q('low')} AS low, {q('high')} AS high, low > -20 AND high < 20 AS inside FROM s JOIN b USING (family, axis)""")
def functional_equivalence(t):
    c = t("orders").groupBy(F.col("o_orderpriority").alias("family"), (F.col("o_custkey") % 40).cast("long").alias("unit"), F.quarter("o_orderdate").alias("axis")).agg((F.avg("o_totalprice").cast("double") / 1000).alias("value"))
    return nulls.functional_equivalence(c.withColumn("g", F.col("unit") < 18), "family", "unit", "axis", "g", 20.0, 0.05, 199, 113)


_HEX = [(500.0, 40.0), (900.0, 260.0), (880.0, 740.0), (480.0, 960.0), (90.0, 700.0), (140.0, 240.0)]
_EDGES = list(zip(_HEX, [*_HEX[1:], _HEX[0]]))
_SEG = "(SELECT * FROM (VALUES " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in _EDGES) + ") s(ax, ay, bx, bz))"


@query(f"""WITH {PTS}, d AS (SELECT pattern_id, idx, x, y, ax, ay, bx, bz, least(1.0, greatest(0.0, ((x - ax) * (bx - ax) + (y - ay) * (bz - ay)) / (pow(bx - ax, 2) + pow(bz - ay, 2)))) AS t FROM pts, {_SEG})
    SELECT pattern_id, idx, {q('min(sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * (bz - ay)), 2)))')} AS distance, count(*) FILTER ((ay > y) <> (bz > y) AND x < (bx - ax) * (y - ay) / (bz - ay) + ax) % 2 = 1 AS inside FROM d GROUP BY 1, 2""")
def polygon_distance(pts):
    return nulls.polygon_distance(pts, _HEX)


@query(f"""WITH s AS (SELECT * FROM {_SEG}) SELECT {q('abs(sum(ax * bz - bx * ay)) / 2')} AS area, {q('sum(sqrt(pow(bx - ax, 2) + pow(bz - ay, 2)))')} AS perimeter, {q('abs(sum(ax * bz - bx * ay)) / 2 + 25.0 * sum(sqrt(pow(bx - ax, 2) + pow(bz - ay, 2))) + pi() * 625')} AS buffered, {q('abs(sum(ax * bz - bx * ay)) / 2')} AS tiled FROM s""")
def polygon_measures(pts):
    spark = pts.sparkSession
    own = nulls.buffered_area(_HEX, 0.0)
    around = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in _EDGES)
    tiled = nulls.tiles(spark, _HEX, 130.0, WINDOW).agg(F.sum("covered").alias("tiled"))
    return tiled.select(F.lit(own).alias("area"), F.lit(around).alias("perimeter"), F.lit(nulls.buffered_area(_HEX, 25.0)).alias("buffered"), "tiled")
