"""Fused sections, registration checks, interaction curves and territories, as queries and SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import key
from ..operators import extras, fusion
from .queries import PR, PTS, draw, q, query, shuffle

AFFINE = (0.0, -1.0, 1000.0, 1.0, 0.0, 0.0)
_PRIMARY = "CASE WHEN section = 'ihc' THEN CASE WHEN mark = 1 THEN 'mmr_abnormal' WHEN mark = 0 THEN 'mmr_retained' WHEN pa >= 0.25 THEN 'mmr_abnormal' ELSE 'mmr_retained' END ELSE label END"
FU = f"""fu AS (SELECT pattern_id, section, idx, x, y, {_PRIMARY} AS "primary" FROM (SELECT pattern_id, 'he' AS section, idx, -1.0 * y + 1000.0 AS x, 1.0 * x AS y, label, mark, pa FROM pts WHERE stratum = 'F'
    UNION ALL SELECT pattern_id, 'ihc', idx, x, y, label, CASE WHEN z % 4 = 0 THEN NULL ELSE mark END, pa FROM pts WHERE stratum = 'O'))"""


def _fused(pts):
    he = pts.where("stratum = 'F'").withColumnRenamed("label", "cell_type")
    ihc = pts.where("stratum = 'O'").withColumn("mark", F.when(F.col("z") % 4 != 0, F.col("mark"))).withColumn("probability", F.col("pa") * 2)
    return fusion.fused(he, ihc, AFFINE)


@query(f"""WITH {PTS}, {FU} SELECT pattern_id, section, idx, {q('x')} AS x, {q('y')} AS y, "primary" FROM fu""")
def fused_sections(pts):
    return _fused(pts)


_LM = f"""lm AS (SELECT pattern_id, idx, x, y, x + (z % 7) AS tx, y - (value % 5) AS ty FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY {draw(51, 'idx')}, idx) AS k FROM pts) WHERE k <= 12)"""


def _landmarks(pts):
    k = F.row_number().over(Window.partitionBy("pattern_id").orderBy(key(51, "idx"), "idx"))
    return pts.withColumn("k", k).where("k <= 12").select("pattern_id", "idx", "x", "y", (F.col("x") + F.col("z") % 7).alias("target_x"), (F.col("y") - F.col("value") % 5).alias("target_y"))


@query(f"""WITH {PTS}, {_LM}, r AS (SELECT pattern_id, sqrt((x + 3 - tx) * (x + 3 - tx) + (y - 2 - ty) * (y - 2 - ty)) AS r FROM lm), k AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY r) AS k, count(*) OVER (PARTITION BY pattern_id) AS n FROM r)
    SELECT pattern_id, count(*) AS landmarks, {q('sqrt(avg(r * r))')} AS rmse, {q('quantile_cont(r, 0.5)')} AS median, {q('max(r) FILTER (k = ceil(n * 95 / 100.0))')} AS p95, {q('max(r)')} AS largest, {q('2.0 * max(r) FILTER (k = ceil(n * 95 / 100.0))')} AS usable_distance FROM k GROUP BY 1""")
def registration_qc(pts):
    return fusion.registration_qc(_landmarks(pts), (1, 0, 3, 0, 1, -2), 2.0)


@query(f"""WITH {PTS}, {_LM}, ed AS (SELECT DISTINCT a.pattern_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bz FROM lm a JOIN lm b ON a.pattern_id = b.pattern_id AND (a.x <> b.x OR a.y <> b.y)),
    hu AS (SELECT e.* FROM ed e JOIN lm p USING (pattern_id) GROUP BY ALL HAVING min((bx - ax) * (p.y - ay) - (bz - ay) * (p.x - ax)) >= 0)
    SELECT p.pattern_id, p.idx, min((bx - ax) * (p.y - ay) - (bz - ay) * (p.x - ax)) >= 0 AS inside FROM pts p JOIN hu USING (pattern_id) GROUP BY 1, 2""")
def hull_extrapolation(pts):
    return fusion.hull_contains(pts, _landmarks(pts))


def bands(curves: str, family: str, alpha: float) -> str:
    """The SQL of envelope_bands over the CTE `curves`(family, replicate, bin, value): CTEs, then a table `band`."""
    return f"""er AS (SELECT {family}, replicate, bin, rank() OVER (PARTITION BY {family}, bin ORDER BY value) + (count(*) OVER (PARTITION BY {family}, bin, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {family}, bin) AS n FROM {curves}),
    ea AS (SELECT {family}, replicate, list_sort(list(least(r, n + 1 - r))) AS v, any_value(n) AS n FROM er GROUP BY ALL),
    ed AS (SELECT {family}, replicate, n, (rank() OVER (PARTITION BY {family} ORDER BY v) + (count(*) OVER (PARTITION BY {family}, v) - 1) / 2.0) / n AS depth FROM ea),
    eo AS (SELECT *, max(CASE WHEN replicate = 0 THEN depth END) OVER (PARTITION BY {family}) AS seen, rank() OVER (PARTITION BY {family} ORDER BY depth) - 1 AS below FROM ed),
    ek AS (SELECT *, depth >= max(CASE WHEN below <= floor({alpha} * n + 1e-12) THEN depth END) OVER (PARTITION BY {family}) AS kept, sum((depth <= seen)::INT) OVER (PARTITION BY {family}) / n AS p_global FROM eo),
    band AS (SELECT {family}, bin, max(value) FILTER (replicate = 0) AS observed, min(value) FILTER (kept) AS lower, max(value) FILTER (kept) AS upper, max(p_global) AS p_global FROM {curves} JOIN ek USING ({family}, replicate) GROUP BY ALL)"""


BAND = f"{q('observed')} AS observed, {q('lower')} AS lower, {q('upper')} AS upper, observed < lower OR observed > upper AS outside, {q('p_global')} AS p_global"
_CROSS = f"""WITH {PTS}, {FU}, fp AS (SELECT a.pattern_id, a.idx AS i, b.idx AS j, least(floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 15), 2)::INT AS bin FROM fu a JOIN fu b ON a.pattern_id = b.pattern_id AND a.idx < b.idx AND abs(a.x - b.x) <= 45 AND abs(a.y - b.y) <= 45
      WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2025), {shuffle('sl', 'fu', 'pattern_id, section', 'idx', '"primary"', 39, 61)},
    al AS (SELECT pattern_id, 0 AS replicate, idx, "primary" AS l FROM fu UNION ALL SELECT pattern_id, replicate, idx, "primary" FROM sl), w AS (SELECT * FROM (VALUES ('A', 'mmr_abnormal'), ('mmr_abnormal', 'mmr_retained')) t(a, b)),
    k AS (SELECT p.pattern_id, x.replicate, p.bin, least(x.l, y.l) AS a, greatest(x.l, y.l) AS b, count(*)::DOUBLE AS v FROM fp p JOIN al x ON x.pattern_id = p.pattern_id AND x.idx = p.i JOIN al y ON y.pattern_id = p.pattern_id AND y.idx = p.j AND y.replicate = x.replicate GROUP BY ALL),
    cv AS (SELECT u.pattern_id, w.a, w.b, r.replicate, c.bin, coalesce(k.v, 0.0) AS value FROM (SELECT DISTINCT pattern_id FROM fu) u CROSS JOIN w CROSS JOIN (SELECT unnest(range(40)) AS replicate) r CROSS JOIN (SELECT unnest(range(3)) AS bin) c
      LEFT JOIN k ON k.pattern_id = u.pattern_id AND k.a = w.a AND k.b = w.b AND k.replicate = r.replicate AND k.bin = c.bin)"""


@query(f"{_CROSS}, {bands('cv', 'pattern_id, a, b', 0.05)} SELECT pattern_id, a, b, bin::INT AS bin, {BAND} FROM band")
def cross_interaction(pts):
    return fusion.cross_interaction(_fused(pts), [("A", "mmr_abnormal"), ("mmr_abnormal", "mmr_retained")], 15.0, 45.0, 39, 61, 0.05)


_TERR = f"""ce AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY {draw(52, 'idx')}, idx) AS k FROM fu) WHERE k <= 4),
    pf AS (SELECT c.pattern_id, c.idx AS territory, f."primary" AS label, count(*) AS cells FROM ce c JOIN fu f ON c.pattern_id = f.pattern_id AND (c.x - f.x) * (c.x - f.x) + (c.y - f.y) * (c.y - f.y) <= 14400 WHERE f."primary" IS NOT NULL GROUP BY 1, 2, 3),
    ps AS (SELECT *, cells / sum(cells) OVER (PARTITION BY pattern_id, territory) AS share FROM pf)"""


def _profiles(pts):
    cells = _fused(pts)
    k = F.row_number().over(Window.partitionBy("pattern_id").orderBy(key(52, "idx"), "idx"))
    return fusion.territory_profiles(cells, cells.withColumn("k", k).where("k <= 4"), 120.0)


@query(f"WITH {PTS}, {FU}, {_TERR} SELECT pattern_id, territory, label, cells, {q('share')} AS share FROM ps")
def territory_profiles(pts):
    return _profiles(pts)


@query(f"""WITH {PTS}, {FU}, {_TERR}, t AS (SELECT DISTINCT pattern_id, territory FROM ps), l AS (SELECT DISTINCT pattern_id, label FROM ps), g AS (SELECT t.pattern_id, territory, label, coalesce(share, 0) AS share FROM t JOIN l USING (pattern_id) LEFT JOIN ps USING (pattern_id, territory, label))
    SELECT a.pattern_id, a.territory AS first, b.territory AS second, {q('max(abs(a.share - b.share))')} AS difference, max(abs(a.share - b.share)) <= 0.1 + 1e-9 AS alike FROM g a JOIN g b ON a.pattern_id = b.pattern_id AND a.label = b.label AND a.territory < b.territory GROUP BY 1, 2, 3""")
def territory_comparison(pts):
    return fusion.territory_comparison(_profiles(pts), 0.1)


# Curves with the envelope of their null ----------------------------------------------------------


@query(f"""WITH {PTS}, {PR}, {shuffle('sm', 'pts', 'pattern_id', 'idx', 'mark', 39, 62)}, al AS (SELECT pattern_id, 0 AS replicate, idx, mark FROM pts UNION ALL SELECT pattern_id, replicate, idx, mark FROM sm), mu AS (SELECT pattern_id, avg(mark) AS m FROM pts GROUP BY 1),
    pb AS (SELECT pattern_id, i, j, CASE WHEN d2 <= 225 THEN 0 WHEN d2 <= 900 THEN 1 ELSE 2 END AS bin FROM pr WHERE i < j),
    kv AS (SELECT p.pattern_id, x.replicate, bin, avg((x.mark - m) * (y.mark - m)) AS v FROM pb p JOIN al x ON x.pattern_id = p.pattern_id AND x.idx = p.i JOIN al y ON y.pattern_id = p.pattern_id AND y.idx = p.j AND y.replicate = x.replicate JOIN mu ON mu.pattern_id = p.pattern_id GROUP BY ALL),
    cv AS (SELECT pattern_id, replicate, bin, round(v, 9) AS value FROM kv), {bands('cv', 'pattern_id', 0.05)} SELECT pattern_id, bin::INT AS bin, {BAND} FROM band""")
def mark_covariance_envelope(pts):
    return _pair_envelope(pts, "mark", lambda a, b, m: (a - m) * (b - m), 62)


@query(f"""WITH {PTS}, {PR}, {shuffle('sm', 'pts', 'pattern_id', 'idx', 'value', 39, 63)}, al AS (SELECT pattern_id, 0 AS replicate, idx, value AS u FROM pts UNION ALL SELECT pattern_id, replicate, idx, value FROM sm),
    pb AS (SELECT pattern_id, i, j, CASE WHEN d2 <= 225 THEN 0 WHEN d2 <= 900 THEN 1 ELSE 2 END AS bin FROM pr WHERE i < j),
    kv AS (SELECT p.pattern_id, x.replicate, bin, avg(0.5 * (x.u - y.u) * (x.u - y.u)) AS v FROM pb p JOIN al x ON x.pattern_id = p.pattern_id AND x.idx = p.i JOIN al y ON y.pattern_id = p.pattern_id AND y.idx = p.j AND y.replicate = x.replicate GROUP BY ALL),
    cv AS (SELECT pattern_id, replicate, bin, round(v, 9) AS value FROM kv), {bands('cv', 'pattern_id', 0.05)} SELECT pattern_id, bin::INT AS bin, {BAND} FROM band""")
def semivariogram_envelope(pts):
    return _pair_envelope(pts, "value", lambda a, b, m: 0.5 * (a - b) * (a - b), 63)


def _pair_envelope(pts, mark: str, statistic, seed: int):
    """The curve of a pair statistic by shell against shuffled marks; m is the pattern's mean mark."""

    def of(drawn, i, j, pdf):
        v = pdf[mark].to_numpy(float)
        return statistic(v[drawn[:, i]], v[drawn[:, j]], np.nanmean(v))

    shell = lambda d2: np.where(d2 <= 225, 0, np.where(d2 <= 900, 1, 2))
    return extras.pair_envelope(pts, [mark], 50.0, shell, 3, of, 39, seed, 0.05)
