"""Further forms of the spatial operators, as queries and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extras, models
from .fusion_queries import BAND, bands
from .queries import _MODES, _SC, _SF, AREA, PR, PTS, RADII, WINDOW, _scores, q, query, shuffle, table_query, unit

_ALLP = "al AS (SELECT a.pattern_id, a.idx AS i, b.idx AS j, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pts a JOIN pts b ON a.pattern_id = b.pattern_id AND a.idx <> b.idx)"


@query(f"""WITH {PTS}, {_MODES}, {_SF.replace('mark', 'pa')}, nz AS (SELECT pattern_id, avg(pa * (1 - pa)) AS noise FROM pts GROUP BY 1) SELECT pattern_id, mx::INT AS mx, my::INT AS my, {q('k')} AS k, {q('power')} AS power, {q('noise')} AS noise FROM sf JOIN nz USING (pattern_id)""")
def probability_powers(pts):
    return extras.probability_powers(pts, models.wave_numbers(pts.sparkSession, 1000.0, 0.006, 0.045), "pa")


@query(f"""WITH {PTS}, {_ALLP}, n AS (SELECT DISTINCT pattern_id, least(i, j) AS i, greatest(i, j) AS j, d2, 2 AS w FROM al QUALIFY row_number() OVER (PARTITION BY pattern_id, al.i ORDER BY d2, al.j) <= 2), b AS (SELECT pattern_id, i, j, d2, 1 AS w FROM al WHERE i < j AND d2 <= 400 UNION ALL SELECT * FROM n)
    SELECT pattern_id, i, j, {q('min(d2)')} AS d2, ['radius', 'nearest', 'both'][sum(w)::INT] AS "by" FROM b GROUP BY 1, 2, 3""")
def graph_union(pts):
    return extras.graph_union(pts, 20.0, 2, 50.0)


@query(f"""WITH {PTS}, {PR}, rs AS (SELECT unnest([15.0, 30.0, 50.0])::DOUBLE AS r), c AS (SELECT pattern_id, r, i, avg(jpa) AS pa, avg(jpb) AS pb, avg(jpc) AS pc FROM pr, rs WHERE d2 <= r * r GROUP BY 1, 2, 3)
    SELECT pattern_id, r, count(*) AS cells, {q('avg(pa)')} AS pa, {q('avg(pb)')} AS pb, {q('avg(pc)')} AS pc, {q('avg(-(' + ' + '.join(f'CASE WHEN {c} > 0 THEN {c} * ln({c}) ELSE 0 END' for c in ('pa', 'pb', 'pc')) + '))')} AS entropy FROM c GROUP BY 1, 2""")
def soft_scales(pts):
    return extras.soft_scales(pts, [15.0, 30.0, 50.0], ["pa", "pb", "pc"])


@query(f"""WITH {PTS}, {PR}, li AS MATERIALIZED (SELECT pattern_id, i, j FROM pr WHERE d2 <= 900), s0 AS MATERIALIZED (SELECT pattern_id, idx, 0 AS s FROM pts WHERE z % 25 = 0),
    {', '.join(f's{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT pattern_id, idx, {k} FROM (SELECT DISTINCT l.pattern_id, l.j AS idx FROM li l JOIN s{k - 1} s ON s.pattern_id = l.pattern_id AND s.idx = l.i) n ANTI JOIN s{k - 1} o USING (pattern_id, idx))' for k in range(1, 5))},
    t AS (SELECT pattern_id, count(*) FILTER (s = 0) AS members, count(*) FILTER (s > 0) AS reached, sum(s) AS total FROM s4 GROUP BY 1) SELECT pattern_id, members, reached, CASE WHEN reached > 0 THEN {q('total / reached')} END AS mean_steps, CASE WHEN total > 0 THEN {q('reached / total')} END AS closeness FROM t""")
def group_closeness(pts):
    return extras.group_closeness(pts, 30.0, F.col("z") % 25 == 0, 4)


_EDGE = "least(x, 1000.0 - x, y, 1000.0 - y)"
_RUNS = f"""cc AS MATERIALIZED (SELECT *, floor(x / 50)::INT AS gx, floor(y / 50)::INT AS gy, {_EDGE} AS b FROM ev), oo AS (SELECT pattern_id, replicate, idx, x, y, l, gx + dx AS gx, gy + dz AS gy FROM cc, (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dz)), rs AS (SELECT unnest([15.0, 30.0, 50.0])::DOUBLE AS r),
    pq AS MATERIALIZED (SELECT a.pattern_id, a.replicate, a.b, a.l AS il, o.l AS jl, (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) AS d2 FROM cc a JOIN oo o USING (pattern_id, replicate, gx, gy) WHERE a.idx <> o.idx AND (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) <= 2500)"""


@query(f"""WITH {PTS}, n AS (SELECT pattern_id, count(*) AS n FROM pts GROUP BY 1), sm AS (SELECT pattern_id, replicate, unnest(range(n)) AS idx FROM n, (SELECT unnest(range(1, 20)) AS replicate)),
    ev AS (SELECT pattern_id, 0 AS replicate, idx, x, y, 'a' AS l FROM pts UNION ALL SELECT pattern_id, replicate, idx, 1000 * {unit(131, 'pattern_id', 'replicate', 'idx')}, 1000 * {unit(132, 'pattern_id', 'replicate', 'idx')}, 'a' FROM sm), {_RUNS},
    el AS (SELECT pattern_id, replicate, r, count(*) FILTER (b >= r) AS e, count(*) AS n FROM cc, rs GROUP BY 1, 2, 3), pc AS (SELECT pattern_id, replicate, r, count(*) AS c FROM pq, rs WHERE d2 <= r * r AND r <= b GROUP BY 1, 2, 3),
    cv AS (SELECT pattern_id, replicate, list_position([15.0, 30.0, 50.0], r) - 1 AS bin, round(coalesce(CASE WHEN e > 0 AND n > 1 THEN sqrt({AREA} * coalesce(c, 0) / (n * e) / pi()) END, 0), 9) AS value FROM el LEFT JOIN pc USING (pattern_id, replicate, r)), {bands('cv', 'pattern_id', 0.1)} SELECT pattern_id, bin::INT AS bin, {BAND} FROM band""")
def border_k_envelope(pts):
    return extras.k_envelope(pts, RADII, WINDOW, 19, 131, 0.1)


@query(f"""WITH {PTS}, {shuffle('sl', 'pts', 'pattern_id', 'idx', 'label', 19, 133)}, ev AS (SELECT pattern_id, 0 AS replicate, idx, x, y, label AS l FROM pts UNION ALL SELECT s.pattern_id, s.replicate, s.idx, p.x, p.y, s.label FROM sl s JOIN (SELECT pattern_id, idx, x, y FROM pts) p USING (pattern_id, idx)), {_RUNS},
    el AS (SELECT pattern_id, replicate, r, count(*) FILTER (l = 'R' AND b >= r) AS e, count(*) FILTER (l = 'R') AS s, count(*) FILTER (l = 'A') AS t FROM cc, rs GROUP BY 1, 2, 3 HAVING s > 0 AND t > 0), pc AS (SELECT pattern_id, replicate, r, count(*) AS c FROM pq, rs WHERE il = 'R' AND jl = 'A' AND d2 <= r * r AND r <= b GROUP BY 1, 2, 3),
    cv AS (SELECT pattern_id, replicate, list_position([15.0, 30.0, 50.0], r) - 1 AS bin, round(coalesce(CASE WHEN e > 0 THEN {AREA} * coalesce(c, 0) / (e * t) END, 0), 9) AS value FROM el LEFT JOIN pc USING (pattern_id, replicate, r)), {bands('cv', 'pattern_id', 0.1)} SELECT pattern_id, bin::INT AS bin, {BAND} FROM band""")
def cross_k_envelope(pts):
    return extras.cross_k_envelope(pts, "R", "A", RADII, WINDOW, 19, 133, 0.1)


@query(f"""WITH {PTS}, {PR}, {shuffle('sv', 'pts', 'pattern_id', 'idx', 'pa, pb, pc', 39, 134)}, al AS (SELECT pattern_id, 0 AS replicate, idx, pa, pb, pc FROM pts UNION ALL SELECT pattern_id, replicate, idx, pa, pb, pc FROM sv), pq AS (SELECT pattern_id, i, j, least(floor(sqrt(d2) / 10), 2)::INT AS bin FROM pr WHERE i < j AND d2 <= 900),
    cv AS (SELECT p.pattern_id, a.replicate, bin, round(avg(0.5 * (pow(a.pa - b.pa, 2) + pow(a.pb - b.pb, 2) + pow(a.pc - b.pc, 2))), 9) AS value FROM pq p JOIN al a ON a.pattern_id = p.pattern_id AND a.idx = p.i JOIN al b ON b.pattern_id = p.pattern_id AND b.idx = p.j AND b.replicate = a.replicate GROUP BY 1, 2, 3),
    {bands('cv', 'pattern_id', 0.05)} SELECT pattern_id, bin::INT AS bin, {BAND} FROM band""")
def embedding_envelope(pts):
    return extras.embedding_envelope(pts, ["pa", "pb", "pc"], 30.0, 3, 39, 134, 0.05)


@query(f"""WITH {PTS}, {_MODES}, ml AS (SELECT * FROM md WHERE k <= 0.02), {shuffle('sm', 'pts', 'pattern_id', 'idx', 'mark', 19, 135)}, al AS (SELECT pattern_id, 0 AS replicate, idx, mark FROM pts UNION ALL SELECT pattern_id, replicate, idx, mark FROM sm), n AS (SELECT pattern_id, count(*) AS n, avg(mark) AS m FROM pts GROUP BY 1),
    po AS (SELECT a.pattern_id, a.replicate, mx, my, (pow(sum((a.mark - m) * cos(kx * x + ky * y)), 2) + pow(sum((a.mark - m) * sin(kx * x + ky * y)), 2)) / any_value(n) AS w FROM al a JOIN pts p USING (pattern_id, idx) JOIN n USING (pattern_id), ml GROUP BY 1, 2, 3, 4),
    v AS (SELECT pattern_id, replicate, sqrt(pow(sum(w * cos(2 * atan2(my, mx))), 2) + pow(sum(w * sin(2 * atan2(my, mx))), 2)) / sum(w) AS v FROM po GROUP BY 1, 2 HAVING sum(w) > 0)
    SELECT s.pattern_id, {q('s.v')} AS anisotropy, {q('avg(v.v)')} AS mean, {q('(1 + count(*) FILTER (v.v >= s.v - 1e-12)) / 20.0')} AS p_high FROM v s JOIN v ON v.pattern_id = s.pattern_id AND v.replicate > 0 WHERE s.replicate = 0 GROUP BY s.pattern_id, s.v""")
def anisotropy_null(pts):
    return extras.anisotropy_null(pts, models.wave_numbers(pts.sparkSession, 1000.0, 0.006, 0.045).where("k <= 0.02"), 19, 135)


@query(f"""WITH {PTS}, a AS (SELECT pattern_id, stratum, {', '.join(f"avg((label = '{c}')::INT) AS {c}" for c in 'ANR')} FROM pts GROUP BY 1, 2), b AS (SELECT pattern_id, avg(A) AS A, avg(N) AS N, avg(R) AS R FROM a GROUP BY 1) SELECT count(*) AS units, {', '.join(f"{q(f'avg({c})')} AS {c}, {q(f'stddev_samp({c})')} AS sd_{c}" for c in 'ANR')} FROM b""")
def patient_levels(pts):
    return extras.patient_levels(pts, ["pattern_id", "stratum"], ["A", "N", "R"])


_LOSS = "round(avg(-(label * ln(greatest(1e-6, least(1 - 1e-6, {0}))) + (1 - label) * ln(1 - greatest(1e-6, least(1 - 1e-6, {0}))))), 12)"


@table_query(f"""WITH {_SC}, w AS (SELECT k / 20.0::DOUBLE AS w FROM (SELECT unnest(range(21)) AS k)), l AS (SELECT lang, w, {_LOSS.format('(w * score + (1 - w) * (0.9 - 0.4 * score))')} AS l FROM s, w GROUP BY 1, 2), b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY lang ORDER BY l, w) = 1)
    SELECT b.lang, {q('b.w')} AS weight, {q('b.l')} AS log_loss, {q('o.l')} AS first_loss, {q('z.l')} AS second_loss FROM b JOIN l o ON o.lang = b.lang AND o.w = 1 JOIN l z ON z.lang = b.lang AND z.w = 0""")
def stacked_scores(t):
    s = _scores(t).withColumn("other", 0.9 - 0.4 * F.col("score"))
    return extras.stacked_scores(s, "lang", ["score", "other"], "label", 20)


@query(f"""WITH {PTS}, g AS (SELECT pattern_id, parent, child FROM (SELECT DISTINCT pattern_id FROM pts), (SELECT unnest(range(12)) AS parent), (SELECT unnest(range(15)) AS child)), c AS (SELECT *, 1000 * {unit(136, 'pattern_id', 'parent')} AS px, 1000 * {unit(137, 'pattern_id', 'parent')} AS py, 25 * sqrt({unit(138, 'pattern_id', 'parent', 'child')}) AS r, 2 * pi() * {unit(139, 'pattern_id', 'parent', 'child')} AS t FROM g)
    SELECT pattern_id, parent::INT AS parent, child::INT AS child, {q('px + r * cos(t)')} AS x, {q('py + r * sin(t)')} AS y FROM c WHERE px + r * cos(t) BETWEEN 0 AND 1000 AND py + r * sin(t) BETWEEN 0 AND 1000""")
def matern_clusters(pts):
    return extras.matern_clusters(pts, WINDOW, 12, 15, 25.0, 136)


@query(f"""WITH {PTS}, s AS (SELECT pattern_id, avg(value) AS y FROM pts GROUP BY 1), d AS (SELECT label AS parameter, stratum, floor(x / 100) AS b, avg(value) AS v FROM pts GROUP BY 1, 2, 3), m AS (SELECT parameter, avg(v) AS m, var_samp(v) AS v FROM d GROUP BY 1 HAVING var_samp(v) > 0),
    l AS (SELECT pattern_id, parameter, -0.5 * (ln(2 * pi() * v) + (y - m) * (y - m) / v) AS l FROM s, m) SELECT pattern_id, parameter, {q('l')} AS log_density, row_number() OVER (PARTITION BY pattern_id ORDER BY round(l, 9) DESC, parameter) = 1 AS best FROM l""")
def synthetic_likelihood(pts):
    draws = pts.groupBy(F.col("label").alias("parameter"), "stratum", F.floor(F.col("x") / 100)).agg(F.avg("value").alias("value")).select("parameter", "value")
    return extras.synthetic_likelihood(pts.groupBy("pattern_id").agg(F.avg("value").alias("value")), draws, "pattern_id", "parameter", "value")
