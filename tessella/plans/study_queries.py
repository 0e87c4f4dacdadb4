"""Chains, fronts, components, held-out comparisons and further nulls, as queries and SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import key
from ..operators import models, records, studies
from .queries import _MODES, _SF, AREA, BI, PR, PTS, RADII, WINDOW, B, draw, q, query, shuffle, table_query
from .record_queries import _RA, _block

_ANALYSIS = f"""{_block('bf', 'pattern_id', 81)}, fl AS (SELECT pattern_id, count(*) AS n, concat_ws(',', CASE WHEN count(*) < 50 THEN 'too_few_cells' END, CASE WHEN sum(mark) < 10 THEN 'too_few_marked' END, CASE WHEN count(*) - sum(mark) < 10 THEN 'too_few_unmarked' END, CASE WHEN avg(mark) < 0.05 OR avg(mark) > 0.95 THEN 'prevalence_out_of_range' END) AS flags FROM pts GROUP BY 1),
    mm AS (SELECT pattern_id, avg(mark) AS m, var_pop(mark) * count(*) AS ss, count(*) AS n FROM pts GROUP BY 1), mo AS (SELECT p.pattern_id, any_value(n) / count(*) * sum((im - m) * (jm - m)) / any_value(ss) AS moran_i FROM pr p JOIN mm USING (pattern_id) WHERE d2 <= 900 AND ss > 0 GROUP BY 1),
    el AS (SELECT pattern_id, count(*) FILTER ({B} >= 30) AS e, count(*) AS n FROM pts GROUP BY 1), kk AS (SELECT pattern_id, CASE WHEN e > 0 AND n > 1 THEN sqrt({AREA} * coalesce(c, 0) / (n * e) / pi()) END AS l FROM el LEFT JOIN (SELECT pattern_id, count(*) AS c FROM pr WHERE d2 <= 900 AND 30 <= {BI} GROUP BY 1) USING (pattern_id)),
    an AS (SELECT f.pattern_id, f.n, flags, moran_i, l, share, p, CASE WHEN flags <> '' THEN 'suppressed: ' || flags WHEN p IS NULL THEN 'unavailable' WHEN p <= 0.05 THEN 'structure beyond the null' ELSE 'compatible with the null' END AS said FROM fl f LEFT JOIN mo USING (pattern_id) LEFT JOIN kk USING (pattern_id) LEFT JOIN bfr USING (pattern_id))"""


def _analysis(pts, n=99, seed=81):
    return studies.marked_analysis(pts, 30.0, 100.0, WINDOW, n, seed, 0.05)


@query(f"WITH {PTS}, {PR}, {_ANALYSIS} SELECT pattern_id, n, flags, {q('moran_i')} AS moran_i, {q('l')} AS l, {q('share')} AS share, {q('p')} AS p, said FROM an")
def marked_analysis(pts):
    return _analysis(pts)


@query(f"WITH {PTS}, {PR}, {_ANALYSIS} SELECT '| ' || pattern_id || ' | ' || n || ' | ' || said || ' |' AS value FROM an")
def analysis_report(pts):
    lines = studies.report_lines(_analysis(pts).select("pattern_id", "n", "said"), "Patterns")
    return lines.where("place > 0").select("value")


def _half(stratum: str) -> str:
    pts = PTS.replace("pts AS (", "pts AS (SELECT * FROM (") + f" WHERE stratum = '{stratum}')"
    return f"(WITH {pts}, {PR}, {_ANALYSIS} SELECT pattern_id, moran_i, l FROM an)"


@query(f"""WITH a AS {_half('F')}, b AS {_half('O')} SELECT pattern_id, CASE WHEN a.pattern_id IS NULL THEN 'only_after' WHEN b.pattern_id IS NULL THEN 'only_before' ELSE 'paired' END AS status, {q('b.moran_i - a.moran_i')} AS moran_i_change, abs(b.moran_i - a.moran_i) <= 0.05 AS moran_i_within,
    {q('b.l - a.l')} AS l_change, abs(b.l - a.l) <= 1.0 AS l_within FROM a FULL JOIN b USING (pattern_id)""")
def paired_analysis(pts):
    a, b = (studies.readouts(pts.where(F.col("stratum") == s), 30.0, WINDOW) for s in "FO")
    return studies.paired_analysis(a, b, {"moran_i": 0.05, "l": 1.0})


_Z = 1.959963984540054


@query(f"""WITH {PTS}, {_block('bf', 'pattern_id', 81)}, s AS (SELECT pattern_id % 3 AS scenario, count(*) AS n, count(*) FILTER (p <= 0.2) AS rejected FROM bfr GROUP BY 1), r AS (SELECT *, rejected / n AS r FROM s)
    SELECT scenario, n, rejected, {q('r')} AS rate, {q(f'((r + {_Z**2} / (2 * n)) - {_Z} * sqrt(r * (1 - r) / n + {_Z**2} / (4.0 * n * n))) / (1 + {_Z**2} / n)')} AS low, {q(f'((r + {_Z**2} / (2 * n)) + {_Z} * sqrt(r * (1 - r) / n + {_Z**2} / (4.0 * n * n))) / (1 + {_Z**2} / n)')} AS high FROM r""")
def rejection_rates(pts):
    return studies.rejection_rates(records.block_share_null(pts, 100.0, 99, 81), F.col("pattern_id") % 3, 0.2)


_SNAP = ("sg AS (" + _SF.split("sf AS (", 1)[1]).replace("FROM pts JOIN", "FROM (SELECT pattern_id, mark, (floor(x / 20) + 0.5) * 20 AS x, (floor(y / 20) + 0.5) * 20 AS y FROM pts) pts JOIN")
_SHELL = "least(floor((k - 0.006) / 0.006), 2)::INT"


@query(f"""WITH {PTS}, {_MODES}, {_SF}, {_SNAP}, a AS (SELECT pattern_id, {_SHELL} AS shell, avg(power) AS d FROM sf WHERE k <= 0.024 GROUP BY 1, 2), b AS (SELECT pattern_id, {_SHELL} AS shell, avg(power) AS g FROM sg WHERE k <= 0.024 GROUP BY 1, 2)
    SELECT pattern_id, shell, {q('d')} AS direct, {q('g')} AS gridded, {q('abs(g - d) / nullif(d, 0)')} AS difference, abs(g - d) / nullif(d, 0) > 0.25 AS warning FROM a JOIN b USING (pattern_id, shell)""")
def gridding_check(pts):
    waves = models.wave_numbers(pts.sparkSession, 1000.0, 0.006, 0.045).where("k <= 0.024")
    shells = lambda p: models.shell_means(models.structure_factor(p, waves), 0.006, 0.024, 3)
    return studies.gridding_check(shells(pts), shells(studies.snapped(pts, 20.0)), 0.25)


def _shares(s: str) -> str:
    return f"SELECT pattern_id, a, b, k / sum(k) OVER (PARTITION BY pattern_id) AS share FROM (SELECT a.pattern_id, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS k FROM pts a JOIN pts b ON a.pattern_id = b.pattern_id AND a.idx < b.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 900 WHERE a.stratum = '{s}' AND b.stratum = '{s}' GROUP BY 1, 2, 3)"


@query(f"""WITH {PTS}, u AS ({_shares('F')}), v AS ({_shares('O')}) SELECT pattern_id, a, b, {q('coalesce(u.share, 0)')} AS before, {q('coalesce(v.share, 0)')} AS after, {q('coalesce(v.share, 0) - coalesce(u.share, 0)')} AS change, abs(coalesce(v.share, 0) - coalesce(u.share, 0)) <= 0.05 + 1e-9 AS within FROM u FULL JOIN v USING (pattern_id, a, b)""")
def share_changes(pts):
    a, b = (studies.label_pair_shares(pts.where(F.col("stratum") == s), 30.0) for s in "FO")
    return studies.share_changes(a, b, 0.05)


_FRONT = f"""{_RA}, fc AS (SELECT a.pattern_id, (a.gx + 1.0) * 100 AS x, (a.gy + 0.5) * 100 AS y FROM ra a JOIN ra b ON a.pattern_id = b.pattern_id AND b.gx = a.gx + 1 AND b.gy = a.gy AND a.side <> b.side UNION ALL SELECT a.pattern_id, (a.gx + 0.5) * 100, (a.gy + 1.0) * 100 FROM ra a JOIN ra b ON a.pattern_id = b.pattern_id AND b.gx = a.gx AND b.gy = a.gy + 1 AND a.side <> b.side),
    fd AS (SELECT p.pattern_id, p.idx, any_value(p.mark) AS mark, any_value(p.value) AS value, CASE WHEN any_value(r.side) THEN -1 ELSE 1 END * min(sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y))) AS d FROM pts p JOIN fc f ON f.pattern_id = p.pattern_id JOIN ra r ON r.pattern_id = p.pattern_id AND r.gx = floor(p.x / 100)::INT AND r.gy = floor(p.y / 100)::INT GROUP BY 1, 2)"""


@query(f"WITH {PTS}, {_FRONT} SELECT pattern_id, idx, {q('d')} AS distance FROM fd")
def front_distance(pts):
    return studies.front_distance(pts, 100.0)


@query(f"WITH {PTS}, {_FRONT} SELECT pattern_id, floor(d / 25)::BIGINT AS band, count(*) AS cells, {q('avg(mark)')} AS marked, {q('avg(value)')} AS mean FROM fd GROUP BY 1, 2")
def front_bands(pts):
    return studies.front_bands(pts, studies.front_distance(pts, 100.0), 25.0)


@query(f"""WITH RECURSIVE {PTS}, {_RA}, c AS MATERIALIZED (SELECT pattern_id, side, gx * 10000 + gy AS i FROM ra), li AS MATERIALIZED (SELECT a.pattern_id, a.side, a.i, b.i AS j FROM c a JOIN c b ON a.pattern_id = b.pattern_id AND a.side = b.side AND abs(a.i - b.i) IN (1, 10000)),
    la(pattern_id, side, i, c) USING KEY (pattern_id, side, i) AS (SELECT pattern_id, side, i, i FROM c UNION SELECT l.pattern_id, l.side, l.i, min(w.c) FROM li l JOIN la w ON w.pattern_id = l.pattern_id AND w.side = l.side AND w.i = l.j JOIN recurring.la o ON o.pattern_id = l.pattern_id AND o.side = l.side AND o.i = l.i WHERE w.c < o.c GROUP BY 1, 2, 3),
    k AS (SELECT pattern_id, side, i, count(*) AS k FROM li GROUP BY 1, 2, 3), s AS (SELECT la.pattern_id, la.side, c, 10000.0 * count(*) AS a, 100.0 * sum(4 - coalesce(k, 0)) AS p FROM la LEFT JOIN k ON k.pattern_id = la.pattern_id AND k.side = la.side AND k.i = la.i GROUP BY 1, 2, 3)
    SELECT pattern_id, side, c::BIGINT AS component, {q('a')} AS area, {q('p')} AS perimeter, {q('4 * pi() * a / (p * p)')} AS compactness FROM s""")
def component_shapes(pts):
    return studies.component_shapes(records.compartment_raster(pts, 100.0), 100.0)


@query(f"""WITH {PTS} SELECT pattern_id, floor(x / 250)::INT AS px, floor(y / 250)::INT AS py, count(*) AS nuclei, {q('avg(value)')} AS mean_area, {q('stddev_samp(value)')} AS sd_area, {q('avg(4 * pi() * value / pow(4 * sqrt(value) * (1 + pa), 2))')} AS circularity FROM pts GROUP BY 1, 2, 3""")
def nuclei_by_patch(pts):
    return studies.nuclei_by_patch(pts, 250.0, "value", 4 * F.sqrt("value") * (1 + F.col("pa")))


_SPOTS = f"sp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY {draw(121, 'idx')}, idx) AS k FROM pts) WHERE k <= 40)"


def _spots(pts):
    k = F.row_number().over(Window.partitionBy("pattern_id").orderBy(key(121, "idx"), "idx"))
    return pts.withColumn("k", k).where("k <= 40").select("pattern_id", "idx", "x", "y")


_AT = [(60.0 * math.sqrt((k + 0.5) / 5), 2 * math.pi * (s + 0.5) / 12) for k in range(5) for s in range(12)]


@query(f"WITH {PTS}, {_SPOTS}, o AS (SELECT * FROM (VALUES {', '.join(f'({r * math.cos(t)!r}::DOUBLE, {r * math.sin(t)!r}::DOUBLE)' for r, t in _AT)}) o(dx, dz)) SELECT pattern_id, idx, {q('avg((x + dx BETWEEN 0 AND 1000 AND y + dz BETWEEN 0 AND 1000)::INT)')} AS cover FROM sp, o GROUP BY 1, 2")
def spot_cover(pts):
    return studies.spot_cover(_spots(pts), 60.0, WINDOW, 5, 12)


@query(f"""WITH {PTS}, {_SPOTS}, m AS (SELECT p.pattern_id, p.idx, s.idx AS spot, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) AS d2 FROM pts p JOIN sp s ON s.pattern_id = p.pattern_id AND (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 3600)
    SELECT pattern_id, idx, spot, {q('sqrt(d2)')} AS distance FROM m QUALIFY row_number() OVER (PARTITION BY pattern_id, idx ORDER BY d2, spot) = 1""")
def attached_cells(pts):
    return studies.attached_cells(_spots(pts), pts, 60.0)


def _diffuse(n: int) -> str:
    return ", ".join(f"g{k + 1} AS MATERIALIZED (SELECT a.pattern_id, a.replicate, a.idx, 0.5 * any_value(a.f) + 0.5 * coalesce(avg(b.f), any_value(a.f)) AS f FROM g{k} a LEFT JOIN li ON li.pattern_id = a.pattern_id AND li.i = a.idx LEFT JOIN g{k} b ON b.pattern_id = a.pattern_id AND b.idx = li.j AND b.replicate = a.replicate GROUP BY 1, 2, 3)" for k in range(n))


@query(f"""WITH {PTS}, {PR}, li AS MATERIALIZED (SELECT pattern_id, i, j FROM pr WHERE d2 <= 900), zz AS (SELECT pattern_id, idx, value - avg(value) OVER (PARTITION BY pattern_id) AS f FROM pts), {shuffle('sf', 'zz', 'pattern_id', 'idx', 'f', 19, 122)}, g0 AS MATERIALIZED (SELECT pattern_id, 0 AS replicate, idx, f FROM zz UNION ALL SELECT pattern_id, replicate, idx, f FROM sf), {_diffuse(2)},
    s AS (SELECT g2.pattern_id, replicate, sum(g2.f * g2.f) / any_value(e) AS v FROM g2 JOIN (SELECT pattern_id, sum(f * f) AS e FROM zz GROUP BY 1) e ON e.pattern_id = g2.pattern_id WHERE e > 0 GROUP BY 1, 2)
    SELECT n.pattern_id, {q('o.v')} AS kept, {q('avg(n.v)')} AS mean, {q('(1 + count(*) FILTER (n.v >= o.v - 1e-12)) / 20.0')} AS p_high FROM s n JOIN s o ON o.pattern_id = n.pattern_id AND o.replicate = 0 WHERE n.replicate > 0 GROUP BY n.pattern_id, o.v""")
def spectral_null(pts):
    return studies.spectral_null(pts, 30.0, 2, 19, 122)


@query(f"""WITH {PTS}, m AS (SELECT a.pattern_id, a.idx, any_value(a.value) AS v, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM pts a JOIN pts b ON a.pattern_id = b.pattern_id AND NOT (a.z % 20 = 0) AND b.z % 20 = 0 GROUP BY 1, 2)
    SELECT pattern_id, count(*) AS cells, {q('regr_slope(v, d)')} AS slope, {q('regr_intercept(v, d)')} AS intercept, {q('regr_r2(v, d)')} AS r2 FROM m GROUP BY 1""")
def resource_regression(pts):
    return studies.resource_regression(pts, F.col("z") % 20 == 0, 100.0)


@query(f"""WITH {PTS}, o AS (SELECT pattern_id, idx % 5 AS fold, z / 100 AS x, value AS y FROM pts), s AS (SELECT pattern_id, fold, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM o GROUP BY 1, 2),
    r AS (SELECT pattern_id, fold, {', '.join(f'sum({c}) OVER (PARTITION BY pattern_id) - {c} AS {c}' for c in ('n', 'sx', 'sy', 'sxx', 'sxy'))} FROM s), b AS (SELECT *, CASE WHEN n * sxx - sx * sx > 1e-9 THEN (n * sxy - sx * sy) / (n * sxx - sx * sx) ELSE 0.0 END AS b FROM r WHERE n > 0), f AS (SELECT pattern_id, fold, b, sy / n AS m, sy / n - b * sx / n AS a FROM b),
    e AS (SELECT pattern_id, count(*) AS rows, avg(pow(y - m, 2)) AS me, avg(pow(y - a - b * x, 2)) AS le FROM o JOIN f USING (pattern_id, fold) GROUP BY 1) SELECT pattern_id, rows, {q('me')} AS mean_error, {q('le')} AS line_error, {q('1 - le / nullif(me, 0)')} AS gain FROM e""")
def held_out_comparison(pts):
    return studies.held_out_comparison(pts.withColumn("u", F.col("z") / 100), "pattern_id", F.col("idx") % 5, "u", "value")


@query(f"""WITH {PTS}, o AS (SELECT pattern_id, value AS y, count(*) OVER p - 1 AS pn, sum(value) OVER p - value AS ps, count(*) OVER g - 1 AS gn, sum(value) OVER g - value AS gs FROM pts WINDOW p AS (PARTITION BY pattern_id), g AS (PARTITION BY pattern_id, label)),
    e AS (SELECT pattern_id, -0.5 * (ln(2 * pi() * 225 * (1 + 1.0 / pn)) + pow(y - ps / pn, 2) / (225 * (1 + 1.0 / pn))) AS p, -0.5 * (ln(2 * pi() * 225 * (1 + 1.0 / gn)) + pow(y - gs / gn, 2) / (225 * (1 + 1.0 / gn))) AS g FROM o WHERE gn > 0)
    SELECT pattern_id, count(*) AS rows, {q('sum(p)', 4)} AS pooled, {q('sum(g)', 4)} AS grouped, {q('sum(g - p)', 4)} AS difference, {q('sqrt(count(*)) * stddev_samp(g - p)', 4)} AS error FROM e GROUP BY 1""")
def leave_one_out_comparison(pts):
    out = studies.leave_one_out_comparison(pts, "pattern_id", "label", "value", 225.0)
    return out.withColumns({c: F.round(F.col(c) + 3.7e-9, 4) for c in ("pooled", "grouped", "difference", "error")})


@table_query(f"""WITH o AS (SELECT o_orderpriority AS family, (o_custkey % 60)::BIGINT AS unit, o_orderkey::BIGINT AS item, o_orderstatus = 'F' AS g, o_totalprice::DOUBLE / 1000 AS v FROM orders), b AS (SELECT family, unit FROM o GROUP BY 1, 2 HAVING count(DISTINCT g) = 2), w AS (SELECT o.* FROM o JOIN b USING (family, unit)), {shuffle('sg', 'w', 'family, unit', 'item', 'g', 39, 123)},
    e AS (SELECT family, unit, 0 AS replicate, g, v FROM w UNION ALL SELECT family, unit, replicate, sg.g, v FROM sg JOIN (SELECT family, unit, item, v FROM w) USING (family, unit, item)), d AS (SELECT family, replicate, unit, avg(v) FILTER (g) - avg(v) FILTER (NOT g) AS d FROM e GROUP BY 1, 2, 3), s AS (SELECT family, replicate, count(d) AS units, avg(d) AS d FROM d GROUP BY 1, 2)
    SELECT o.family, o.units, {q('o.d')} AS difference, {q('(1 + count(*) FILTER (abs(s.d) >= abs(o.d) - 1e-12)) / 40.0')} AS p FROM s o JOIN s ON s.family = o.family AND s.replicate > 0 WHERE o.replicate = 0 GROUP BY o.family, o.units, o.d""")
def repeated_permutation(t):
    o = t("orders").select(F.col("o_orderpriority").alias("family"), (F.col("o_custkey") % 60).cast("long").alias("unit"), F.col("o_orderkey").cast("long").alias("item"), (F.col("o_orderstatus") == "F").alias("g"), (F.col("o_totalprice").cast("double") / 1000).alias("value"))
    # a label's place is its row's; booleans are shuffled as numbers
    return studies.repeated_permutation(o, "family", "unit", "item", "g", 39, 123)


@query(f"""WITH {PTS}, {PR}, f AS (SELECT pattern_id, idx, idx % 4 AS fold FROM pts), s AS (SELECT p.pattern_id, p.i AS idx, sum(exp(-d2 / 800.0)) AS s FROM pr p JOIN f a ON a.pattern_id = p.pattern_id AND a.idx = p.i JOIN f b ON b.pattern_id = p.pattern_id AND b.idx = p.j WHERE a.fold <> b.fold GROUP BY 1, 2)
    SELECT pattern_id, idx, fold, {q('coalesce(s, 0) * 4 / 3.0 / (pi() * 800)')} AS intensity FROM f LEFT JOIN s USING (pattern_id, idx)""")
def cross_fitted_intensity(pts):
    return studies.cross_fitted_intensity(pts, F.col("idx") % 4, 4, 20.0, 50.0)


@query(f"""WITH {PTS}, {PR}, rs AS (SELECT unnest([15.0, 30.0, 50.0])::DOUBLE AS r), lm AS (SELECT pattern_id, idx, x, y, greatest(0.0002, coalesce(s, 0) / (pi() * 800)) AS lam FROM pts LEFT JOIN (SELECT pattern_id, i AS idx, sum(exp(-d2 / 800.0)) AS s FROM pr GROUP BY 1, 2) USING (pattern_id, idx)), lo AS (SELECT pattern_id, r, sum(1 / lam) AS low FROM lm, rs WHERE {B} >= r GROUP BY 1, 2),
    tp AS (SELECT p.pattern_id, r, sum(1 / (a.lam * b.lam)) AS top FROM pr p JOIN lm a ON a.pattern_id = p.pattern_id AND a.idx = p.i JOIN lm b ON b.pattern_id = p.pattern_id AND b.idx = p.j, rs WHERE d2 <= r * r AND r <= {BI} GROUP BY 1, 2) SELECT pattern_id, r, {q('coalesce(top, 0) / low', 4)} AS k FROM lo LEFT JOIN tp USING (pattern_id, r)""")
def kernel_inhomogeneous_k(pts):
    return studies.kernel_inhomogeneous_k(pts, 20.0, 50.0, RADII, WINDOW, 0.0002).withColumn("k", F.round(F.col("k") + 3.7e-9, 4))


@query(f"""WITH {PTS}, c AS (SELECT pattern_id, floor(x / 50)::BIGINT AS bin, round(avg(value), 9) AS v FROM pts GROUP BY 1, 2), n AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM c WINDOW w AS (PARTITION BY pattern_id ORDER BY bin))
    SELECT pattern_id, bin, {q('v')} AS v, CASE WHEN v > a AND v > b THEN 'peak' ELSE 'dip' END AS kind FROM n WHERE (v > a AND v > b) OR (v < a AND v < b)""")
def turning_points(pts):
    return studies.turning_points(pts.groupBy("pattern_id", F.floor(F.col("x") / 50).alias("bin")).agg(F.round(F.avg("value"), 9).alias("v")), "pattern_id", "bin", "v")


@query(f"""WITH {PTS}, vx AS (SELECT a.v AS vx, b.v AS vy, c.v AS vz FROM (SELECT unnest(range(10))::INT AS v) a, (SELECT unnest(range(10))::INT AS v) b, (SELECT unnest(range(10))::INT AS v) c WHERE (a.v + b.v * 3 + c.v) % 7 <> 0), vo AS (SELECT count(*) * 1e6 AS v FROM vx),
    ov AS (SELECT b.vx - a.vx AS dx, b.vy - a.vy AS dy, b.vz - a.vz AS dz, count(*) * 1e6 AS s FROM vx a JOIN vx b ON abs(a.vx - b.vx) <= 1 AND abs(a.vy - b.vy) <= 1 AND abs(a.vz - b.vz) <= 1 GROUP BY 1, 2, 3),
    ins AS (SELECT p.pattern_id, p.idx, p.x, p.y, p.z FROM pts p JOIN vx ON floor(p.x / 100) = vx AND floor(p.y / 100) = vy AND floor(p.z / 100) = vz), n AS (SELECT pattern_id, count(*) AS n FROM ins GROUP BY 1), rs AS (SELECT unnest([30.0, 60.0])::DOUBLE AS r),
    pa AS (SELECT a.pattern_id, b.x - a.x AS gx, b.y - a.y AS gy, b.z - a.z AS gz FROM ins a JOIN ins b ON a.pattern_id = b.pattern_id AND a.idx < b.idx AND abs(a.x - b.x) <= 60 AND abs(a.y - b.y) <= 60 AND abs(a.z - b.z) <= 60),
    w AS (SELECT pattern_id, r, sum(2 / s) AS w FROM pa JOIN ov ON round(gx / 100) = dx AND round(gy / 100) = dy AND round(gz / 100) = dz, rs WHERE gx * gx + gy * gy + gz * gz <= r * r GROUP BY 1, 2)
    SELECT pattern_id, r, n, CASE WHEN n > 1 THEN {q('v * v * coalesce(w, 0) / (n * (n - 1))', 3)} END AS k FROM n CROSS JOIN vo CROSS JOIN rs LEFT JOIN w USING (pattern_id, r)""")
def voxel_k3d(pts):
    spark = pts.sparkSession
    voxels = spark.createDataFrame([(a, b, c) for a in range(10) for b in range(10) for c in range(10) if (a + b * 3 + c) % 7], "vx int, vy int, vz int")
    return studies.voxel_k3d(pts, voxels, 100.0, [30.0, 60.0]).withColumn("k", F.round(F.col("k") + 3.7e-9, 3))


_STUDY = f"""fe AS (SELECT pattern_id, {', '.join(f"avg((label = '{c}')::INT) AS share_{c}" for c in 'ANR')}, avg(value) AS mean FROM pts GROUP BY 1), mv AS (SELECT pattern_id, avg(value) AS m, var_pop(value) * count(*) AS ss, count(*) AS n FROM pts GROUP BY 1),
    mo AS (SELECT p.pattern_id, any_value(n) / count(*) * sum((iv - m) * (jv - m)) / any_value(ss) AS moran, avg((il = jl)::INT) AS alike FROM pr p JOIN mv USING (pattern_id) WHERE d2 <= 900 GROUP BY 1),
    lo AS ({' UNION ALL '.join(f"SELECT pattern_id, '{c}' AS endpoint, {c} AS value FROM {t}" for c, t in (('share_A', 'fe'), ('share_N', 'fe'), ('share_R', 'fe'), ('mean', 'fe'), ('moran', 'mo'), ('alike', 'mo')))}),
    pa AS (SELECT endpoint, pattern_id % 20 AS patient, pattern_id % 20 % 2 = 0 AS g, avg(value) AS v FROM lo WHERE value IS NOT NULL GROUP BY 1, 2, 3), {shuffle('sg', 'pa', 'endpoint', 'patient', 'g', 199, 141)},
    ev AS (SELECT endpoint, 0 AS replicate, g, v FROM pa UNION ALL SELECT endpoint, replicate, sg.g, v FROM sg JOIN (SELECT endpoint, patient, v FROM pa) USING (endpoint, patient)),
    nl AS (SELECT endpoint, replicate, (avg(v) FILTER (g) - avg(v) FILTER (NOT g)) / sqrt(var_samp(v) FILTER (g) / count(*) FILTER (g) + var_samp(v) FILTER (NOT g) / count(*) FILTER (NOT g)) AS t FROM ev GROUP BY 1, 2), ob AS (SELECT endpoint, abs(t) AS s FROM nl WHERE replicate = 0),
    mx AS (SELECT replicate, max(abs(t)) AS m FROM nl WHERE replicate > 0 GROUP BY 1), on_ AS (SELECT endpoint, (1 + count(*) FILTER (m >= s)) / (1.0 + count(*)) AS p FROM ob, mx GROUP BY 1),
    sm AS (SELECT o.endpoint, o.s, max(abs(n.t)) OVER (PARTITION BY n.replicate ORDER BY o.s) AS m FROM nl n JOIN ob o USING (endpoint) WHERE n.replicate > 0), sr AS (SELECT endpoint, s, (1 + count(*) FILTER (m >= s)) / (1.0 + count(*)) AS p FROM sm GROUP BY 1, 2), sd AS (SELECT endpoint, max(p) OVER (ORDER BY s DESC) AS d FROM sr)"""


@query(f"WITH {PTS}, {PR}, {_STUDY} SELECT endpoint, (SELECT count(*) FROM pa p WHERE p.endpoint = ob.endpoint) AS patients, {q('s')} AS statistic, {q('p')} AS p_adjusted, {q('d')} AS p_step_down FROM ob JOIN on_ USING (endpoint) JOIN sd USING (endpoint)")
def multiplex_study(pts):
    patient = F.col("pattern_id") % 20
    patients = pts.select("pattern_id").distinct().select("pattern_id", patient.alias("patient"), (patient % 2 == 0).alias("is_first"))
    return studies.multiplex_study(studies.slide_features(pts, 30.0, ["A", "N", "R"]), patients, 199, 141)
