"""Queries of edge corrections, rasters, group comparisons and graph signals, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cohort, dynamics, graphs, groups, inference, models, morphology, point_process, spectra, tables
from .queries import _MODES, _N, _NULL, _PAT, _SC, _SF, _WE, _null, AREA, BASE, BI, PR, PTS, RADII, WINDOW, B, _patients, _powers, _scores, draw, normal_sql, poisson_sql, q, query, shuffle, table_query, transport_sql, unit

# Edge corrections and fits of point patterns -----------------------------------------------------

_RG, _H = [15.0, 30.0, 40.0], 10.0
_RGS = "rs AS (SELECT unnest([15.0, 30.0, 40.0])::DOUBLE AS r)"
_KER = "0.75 * (1 - ((r - sqrt(d2)) / 10.0) * ((r - sqrt(d2)) / 10.0)) / 10.0"
_ARC = "acos(least(1.0, {} / nullif(sqrt(d2), 0)))"
_L, _R, _D, _U = (_ARC.format(s) for s in ("ix", "(1000.0 - ix)", "iy", "(1000.0 - iy)"))
_OUT = f"(2 * ({_L} + {_R} + {_D} + {_U}) - " + " - ".join(f"greatest(0.0, {a} + {b} - pi() / 2)" for a in (_L, _R) for b in (_D, _U)) + ")"
_ISO = f"(1 / (1 - {_OUT} / (2 * pi())))"
_LAM = "lam AS (SELECT pattern_id, idx, count(*) OVER (PARTITION BY pattern_id, x < 500) / 500000.0 AS lam FROM pts)"


@query(f"""{BASE}, {_N}, w AS (SELECT pattern_id, r, sum({_ISO}) AS w FROM pr, rs WHERE d2 <= r * r GROUP BY 1, 2), k AS (SELECT pattern_id, r, n, CASE WHEN n > 1 THEN {AREA} * coalesce(w, 0) / (n * (n - 1)) END AS k FROM n CROSS JOIN rs LEFT JOIN w USING (pattern_id, r))
    SELECT pattern_id, r, n, {q('k')} AS k, {q('sqrt(k / pi())')} AS l FROM k""")
def isotropic_k(pts):
    return point_process.isotropic_k(pts, RADII, WINDOW)


@query(f"""WITH {PTS}, {PR}, {_RGS}, {_N}, w AS (SELECT pattern_id, r, sum({_ISO} * {_KER}) AS w FROM pr, rs WHERE abs(r - sqrt(d2)) < 10 GROUP BY 1, 2)
    SELECT pattern_id, r, n, CASE WHEN n > 1 THEN {q(f'{AREA} * coalesce(w, 0) / (2 * pi() * r * n * (n - 1))')} END AS g FROM n CROSS JOIN rs LEFT JOIN w USING (pattern_id, r)""")
def isotropic_pair_correlation(pts):
    return point_process.isotropic_g(pts, _RG, _H, WINDOW)


@query(f"""WITH {PTS}, {PR}, {_RGS}, t AS (SELECT pattern_id, count(*) AS targets FROM pts WHERE label = 'A' GROUP BY 1),
    el AS (SELECT pattern_id, r, count(*) FILTER ({B} >= r + 10) AS eligible, count(*) AS sources FROM pts, rs WHERE label = 'R' GROUP BY 1, 2),
    w AS (SELECT pattern_id, r, sum({_KER}) AS w FROM pr, rs WHERE il = 'R' AND jl = 'A' AND abs(r - sqrt(d2)) < 10 AND r + 10 <= {BI} GROUP BY 1, 2)
    SELECT pattern_id, r, sources, targets, eligible, CASE WHEN eligible > 0 THEN {q(f'{AREA} * coalesce(w, 0) / (2 * pi() * r * targets * eligible)')} END AS g FROM el JOIN t USING (pattern_id) LEFT JOIN w USING (pattern_id, r)""")
def directed_cross_pair_correlation(pts):
    return point_process.cross_g(pts, "R", "A", _RG, _H, WINDOW)


@query(f"""WITH {PTS}, {PR}, {_RGS}, {_LAM}, low AS (SELECT pattern_id, r, sum(1 / lam) AS low FROM pts JOIN lam USING (pattern_id, idx), rs WHERE {B} >= r + 10 GROUP BY 1, 2),
    top AS (SELECT pr.pattern_id, r, sum({_KER} / (a.lam * b.lam)) AS top FROM pr JOIN lam a ON a.pattern_id = pr.pattern_id AND a.idx = pr.i JOIN lam b ON b.pattern_id = pr.pattern_id AND b.idx = pr.j, rs WHERE abs(r - sqrt(d2)) < 10 AND r + 10 <= {BI} GROUP BY 1, 2)
    SELECT pattern_id, r, {q('coalesce(top, 0) / low / (2 * pi() * r)')} AS g FROM low LEFT JOIN top USING (pattern_id, r)""")
def piecewise_inhomogeneous_pair_correlation(pts):
    rich = pts.withColumn("side", F.col("x") < 500)
    return point_process.inhomogeneous_g(rich, F.count(F.lit(1)).over(Window.partitionBy("pattern_id", "side")) / 500000.0, _RG, _H, WINDOW)


@query(f"""WITH {PTS}, {PR}, h AS (SELECT unnest([8.0, 12.0, 16.0])::DOUBLE AS h), s AS (SELECT pattern_id, i AS idx, h, sum(exp(-d2 / (2 * h * h))) AS s FROM pr, h GROUP BY 1, 2, 3),
    c AS (SELECT pattern_id, h, avg(ln(greatest(coalesce(s, 0) / (2 * pi() * h * h), 1e-12))) AS score FROM (SELECT pattern_id, idx, h FROM pts, h) LEFT JOIN s USING (pattern_id, idx, h) GROUP BY 1, 2)
    SELECT pattern_id, h AS bandwidth, {q('score')} AS score, row_number() OVER (PARTITION BY pattern_id ORDER BY score DESC, h) = 1 AS selected FROM c""")
def bandwidth_selection(pts):
    return point_process.bandwidth_selection(pts, [8.0, 12.0, 16.0], 50.0)


@query(f"""WITH {PTS}, g AS (SELECT sum(exp(-7.5 + 0.5 * (a.v + 0.5) * 50 / 1000.0 - 0.25 * (b.v + 0.5) * 50 / 1000.0)) * 2500 AS integral FROM (SELECT unnest(range(20)) AS v) a, (SELECT unnest(range(20)) AS v) b),
    e AS (SELECT pattern_id, count(*) AS n, sum(-7.5 + 0.5 * x / 1000.0 - 0.25 * y / 1000.0) AS events FROM pts GROUP BY 1)
    SELECT pattern_id, n, {q('events')} AS events, {q('integral')} AS integral, {q('events - integral')} AS log_likelihood FROM e, g""")
def poisson_log_likelihood(pts):
    return point_process.poisson_log_likelihood(pts, -7.5 + 0.5 * F.col("x") / 1000.0 - 0.25 * F.col("y") / 1000.0, WINDOW, 20)


@query(f"""WITH {PTS}, {PR}, t AS (SELECT pattern_id, i AS idx, count(*) AS t FROM pr WHERE d2 <= 900 GROUP BY 1, 2)
    SELECT pattern_id, idx, coalesce(t, 0) AS neighbours, {q('-7.0 - 0.25 * coalesce(t, 0)')} AS log_intensity FROM pts LEFT JOIN t USING (pattern_id, idx)""")
def conditional_intensity(pts):
    return point_process.conditional_intensity(pts, 30.0, -7.0, -0.25)


@query(f"""{BASE}, el AS (SELECT pattern_id, r, count(*) FILTER ({B} >= r) AS eligible, count(*) AS n FROM pts, rs GROUP BY 1, 2), c AS (SELECT pattern_id, r, count(*) AS pairs FROM pr, rs WHERE d2 <= r * r AND r <= {BI} GROUP BY 1, 2),
    k AS (SELECT pattern_id, r, {AREA} * coalesce(pairs, 0) / (n * eligible) AS k FROM el LEFT JOIN c USING (pattern_id, r) WHERE eligible > 0 AND n > 1),
    g AS (SELECT d, s FROM (SELECT unnest([0.0001, 0.0003, 0.001])::DOUBLE AS d), (SELECT unnest([5.0, 10.0, 20.0])::DOUBLE AS s)),
    m AS (SELECT pattern_id, d, s, sum(pow(pow(k, 0.25) - pow(pi() * r * r + (1 - exp(-r * r / (4 * s * s))) / d, 0.25), 2)) AS contrast FROM k, g GROUP BY 1, 2, 3)
    SELECT pattern_id, d AS density, s AS scale, {q('contrast')} AS contrast FROM m QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY contrast, d, s) = 1""")
def minimum_contrast(pts):
    return point_process.minimum_contrast(point_process.border_k(pts, RADII, WINDOW), [0.0001, 0.0003, 0.001], [5.0, 10.0, 20.0])


_SHELL = "CASE WHEN d2 <= 225 THEN 15.0 WHEN d2 <= 900 THEN 30.0 ELSE 50.0 END::DOUBLE AS shell"


@query(f"""WITH {PTS}, {PR}, m AS (SELECT pattern_id, avg(value) AS mf, avg(z) AS ms FROM pts GROUP BY 1)
    SELECT pattern_id, {_SHELL}, count(*) AS pairs, {q('avg((iv - mf) * (jz - ms))')} AS covariance FROM pr JOIN m USING (pattern_id) GROUP BY 1, 2""")
def cross_covariance(pts):
    return point_process.cross_covariance(pts, RADII, "value", "z")


@query(f"""WITH {PTS}, {PR}, m AS (SELECT pattern_id, (sum(value) * sum(value) - sum(value * value) + sum(z) * sum(z) - sum(z * z)) / (count(*) * (count(*) - 1)) AS whole FROM pts GROUP BY 1 HAVING count(*) > 1)
    SELECT pattern_id, shell, count(*) // 2 AS pairs, {q('avg(dot) / any_value(whole)')} AS correlation FROM (SELECT pattern_id, {_SHELL}, iv * jv + iz * jz AS dot FROM pr) JOIN m USING (pattern_id) GROUP BY 1, 2""")
def kernel_mark_correlation(pts):
    return point_process.kernel_mark_correlation(pts, RADII, ["value", "z"])


@query(f"""{BASE}, n AS (SELECT pattern_id, count(*) FILTER (label = 'R') AS sources, count(*) FILTER (label = 'A') AS targets FROM pts GROUP BY 1 HAVING sources > 0 AND targets > 0),
    c AS (SELECT pattern_id, r, count(*) AS pairs FROM pr, rs WHERE il = 'R' AND jl = 'A' AND d2 + (iz - jz) * (iz - jz) <= r * r GROUP BY 1, 2)
    SELECT pattern_id, r, sources, targets, coalesce(pairs, 0) AS pairs, {q('1e9 * coalesce(pairs, 0) / (sources * targets)')} AS k FROM n CROSS JOIN rs LEFT JOIN c USING (pattern_id, r)""")
def directed_cross_k3d(pts):
    return point_process.cross_k3d(pts, "R", "A", RADII, 1e9)


# Rasters, bands, landmarks -----------------------------------------------------------------------

_BANDS = [0.0, 50.0, 100.0, 200.0, 500.0]
_RINGS = [(1000 - 2 * a) ** 2 - (1000 - 2 * b) ** 2 for a, b in zip(_BANDS, _BANDS[1:])]
_BAND = f"CASE WHEN {B} < 50 THEN 0 WHEN {B} < 100 THEN 1 WHEN {B} < 200 THEN 2 ELSE 3 END"


@query(f"""WITH {PTS} SELECT pattern_id, {_BAND} AS band, count(*) AS cells, count(value) AS observed, {q('avg(value)')} AS mean, count(DISTINCT label) AS labels, {q(f'count(*) / list_extract({_RINGS}, any_value({_BAND}) + 1) * 1e6')} AS density
    FROM pts WHERE {B} < 500 GROUP BY 1, 2""")
def distance_band_profile(pts):
    return morphology.banded_profile(pts, point_process.boundary_distance(WINDOW), _BANDS, _RINGS)


@query(f"""WITH {PTS} SELECT pattern_id, (floor((x - 500) / 100) + 5)::INT AS band, count(*) AS cells, count(value) AS observed, {q('avg(value)')} AS mean, count(DISTINCT label) AS labels, {q('count(*) / 100000.0 * 1e6')} AS density FROM pts GROUP BY 1, 2""")
def interface_profile(pts):
    return morphology.banded_profile(pts, F.col("x") - 500, [100.0 * k for k in range(-5, 6)], [100000.0] * 10)


@query(f"""WITH {PTS}, {PR}, c AS (SELECT pattern_id, idx, coalesce(k, 0) + 1 AS cells FROM (SELECT pattern_id, idx FROM pts WHERE mark = 1)
      LEFT JOIN (SELECT pattern_id, i AS idx, count(*) AS k FROM pr WHERE im = 1 AND jm = 1 GROUP BY 1, 2) USING (pattern_id, idx))
    SELECT pattern_id, idx, cells FROM c QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY cells DESC, idx) = 1""")
def budding_hotspot(pts):
    return morphology.disc_hotspot(pts.where("mark = 1"), 50.0)


@query(f"""WITH {PTS}, b AS (SELECT pattern_id, floor(x / 50)::INT AS gx, floor(y / 50)::INT AS gy, count(*) AS m FROM pts GROUP BY 1, 2, 3), s AS (SELECT unnest([1, 2, 4]) AS size),
    p AS (SELECT size, a.v AS bx, c.v AS oy FROM s, (SELECT unnest(range(20)) AS v) a, (SELECT unnest(range(20)) AS v) c WHERE a.v <= 20 - size AND c.v <= 20 - size),
    w AS (SELECT pattern_id, size, bx, oy, sum(m) AS m FROM b, p WHERE gx BETWEEN bx AND bx + size - 1 AND gy BETWEEN oy AND oy + size - 1 GROUP BY 1, 2, 3, 4)
    SELECT pattern_id, size, {q('sum(m * m) * (21 - size) * (21 - size) / (sum(m) * sum(m))::DOUBLE')} AS lacunarity FROM w GROUP BY 1, 2""")
def lacunarity(pts):
    return morphology.lacunarity(pts, 50.0, 20, [1, 2, 4])


@query(f"""WITH {PTS}, f AS (SELECT DISTINCT pattern_id, floor(x / 50)::INT AS gx, floor(y / 50)::INT AS gy FROM pts),
    e AS (SELECT pattern_id, a, b, w, count(*) AS k FROM (SELECT pattern_id, gx AS a, gy AS b, 0 AS w FROM f UNION ALL SELECT pattern_id, gx, gy + 1, 0 FROM f UNION ALL SELECT pattern_id, gx, gy, 1 FROM f UNION ALL SELECT pattern_id, gx + 1, gy, 1 FROM f) GROUP BY ALL),
    v AS (SELECT pattern_id, gx AS a, gy AS b FROM f UNION SELECT pattern_id, gx + 1, gy FROM f UNION SELECT pattern_id, gx, gy + 1 FROM f UNION SELECT pattern_id, gx + 1, gy + 1 FROM f)
    SELECT pattern_id, s * 2500.0::DOUBLE AS area, o * 50.0::DOUBLE AS perimeter, v - e + s AS euler FROM (SELECT pattern_id, count(*) AS s FROM f GROUP BY 1)
      JOIN (SELECT pattern_id, count(*) AS e, count(*) FILTER (k = 1) AS o FROM e GROUP BY 1) USING (pattern_id) JOIN (SELECT pattern_id, count(*) AS v FROM v GROUP BY 1) USING (pattern_id)""")
def raster_morphology(pts):
    return morphology.raster_morphology(pts, 50.0)


_ANG = "(value * 0.05 + z * 0.0031)"
_DIR = f"""t AS (SELECT pattern_id, floor(x / 200)::BIGINT AS gx, floor(y / 200)::BIGINT AS gy, count(*) AS n, avg(cos(2 * {_ANG})) AS c, avg(sin(2 * {_ANG})) AS s FROM pts GROUP BY 1, 2, 3),
    d AS (SELECT pattern_id, gx, gy, n, sqrt(c * c + s * s) AS ord, atan2(s, c) / 2 AS dir FROM t)"""


def _field(pts):
    return morphology.directors(pts, F.col("value") * 0.05 + F.col("z") * 0.0031, 200.0)


@query(f"""WITH {PTS}, {_DIR} SELECT pattern_id, gx, gy, n, {q('ord')} AS "order", {q('dir')} AS director FROM d""")
def nematic_directors(pts):
    return _field(pts)


def _turn(a: str, b: str) -> str:
    return f"({b}.dir - {a}.dir - pi() * round(({b}.dir - {a}.dir) / pi()))"


@query(f"""WITH {PTS}, {_DIR}, r AS (SELECT a.pattern_id, a.gx, a.gy, {' + '.join(_turn(*e) for e in ('ab', 'bc', 'ce', 'ea'))} AS total
      FROM d a JOIN d b ON b.pattern_id = a.pattern_id AND b.gx = a.gx + 1 AND b.gy = a.gy JOIN d c ON c.pattern_id = a.pattern_id AND c.gx = a.gx + 1 AND c.gy = a.gy + 1 JOIN d e ON e.pattern_id = a.pattern_id AND e.gx = a.gx AND e.gy = a.gy + 1)
    SELECT pattern_id, gx, gy, {q('round(total / pi()) / 2')} AS charge FROM r WHERE round(total / pi()) <> 0""")
def nematic_defects(pts):
    return morphology.half_defects(_field(pts))


@query(f"""WITH {PTS}, {_MODES}, {_SF}, m AS (SELECT * FROM sf WHERE k <= 0.03 AND power > 0)
    SELECT pattern_id, count(*) AS modes, {q('regr_intercept(power, k)')} AS s0, {q('regr_slope(ln(power), ln(k))')} AS alpha, {q('regr_intercept(power, k) / max(power)')} AS ratio FROM m GROUP BY 1""")
def hyperuniformity(pts):
    return morphology.small_wave_limit(_powers(pts), 0.03)


_UV = "l AS (SELECT pattern_id, x / 100 AS x, y / 100 AS y, (0.9 * x - 0.2 * y + value) / 100 AS u, (0.25 * x + 0.95 * y - value / 2) / 100 AS v FROM pts)"


@query(f"""WITH {PTS}, {_UV}, m AS (SELECT pattern_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, var_pop(u) + var_pop(v) AS tt FROM l GROUP BY 1),
    s AS (SELECT *, atan2(xv - yu, xu + yv) AS theta, xx * yy - xy * xy AS det FROM m), f AS (SELECT *, (yy * xu - xy * yu) / det AS a, (xx * yu - xy * xu) / det AS b, (yy * xv - xy * yv) / det AS c, (xx * yv - xy * xv) / det AS d FROM s)
    SELECT pattern_id, n, {q('theta')} AS theta, {q('mu - cos(theta) * mx + sin(theta) * my')} AS shift_x, {q('mv - sin(theta) * mx - cos(theta) * my')} AS shift_y, {q('sqrt(greatest(tt + xx + yy - 2 * sqrt((xv - yu) * (xv - yu) + (xu + yv) * (xu + yv)), 0))')} AS rigid_rmse,
      {q('a')} AS a, {q('b')} AS b, {q('c')} AS c, {q('d')} AS d, {q('mu - a * mx - b * my')} AS e, {q('mv - c * mx - d * my')} AS f, {q('sqrt(greatest(tt - (a * xu + b * yu + c * xv + d * yv), 0))')} AS affine_rmse FROM f""")
def landmark_fits(pts):
    x, y, v = F.col("x"), F.col("y"), F.col("value")
    return morphology.landmark_fits(pts.select("pattern_id", (x / 100).alias("x"), (y / 100).alias("y"), ((0.9 * x - 0.2 * y + v) / 100).alias("u"), ((0.25 * x + 0.95 * y - v / 2) / 100).alias("v")))


# Graph signals -----------------------------------------------------------------------------------


@query(f"""WITH {PTS}, {PR}, o AS (SELECT pattern_id, count(*) AS outside FROM pts WHERE mark <> 1 GROUP BY 1), t AS (SELECT pattern_id, count(DISTINCT i) AS touched FROM pr WHERE im <> 1 AND jm = 1 AND d2 <= 900 GROUP BY 1)
    SELECT pattern_id, outside, coalesce(touched, 0) AS touched, {q('coalesce(touched, 0) / outside')} AS group_degree FROM o LEFT JOIN t USING (pattern_id)""")
def group_degree(pts):
    return graphs.group_degree(pts, 30.0)


@query(f"""WITH {PTS}, {PR}, m AS (SELECT pattern_id, i AS idx, coalesce(0.25 * avg(jv) FILTER (jl = 'A'), 0) + coalesce(0.15 * avg(jv) FILTER (jl = 'N'), 0) + coalesce(0.1 * avg(jv) FILTER (jl = 'R'), 0) AS m FROM pr WHERE d2 <= 900 GROUP BY 1, 2)
    SELECT pattern_id, idx, {q('0.5 * value + coalesce(m, 0)')} AS signal FROM pts LEFT JOIN m USING (pattern_id, idx)""")
def typed_messages(pts):
    return graphs.typed_messages(pts, 30.0, {"A": 0.25, "N": 0.15, "R": 0.1}, 0.5)


@query(f"""WITH {PTS}, {PR} SELECT pattern_id, i, j, {q('sqrt(d2 + (iz - jz) * (iz - jz))')} AS distance FROM pr WHERE i < j AND d2 + (iz - jz) * (iz - jz) <= 2500""")
def radius_graph_3d(pts):
    return graphs.edges_3d(pts, 50.0)


@query(f"""WITH {PTS}, {PR} SELECT pattern_id, count(*) AS edges, count(*) FILTER (il <> jl) AS crossing, {q('count(*) FILTER (il <> jl) / count(*)')} AS share FROM pr WHERE i < j AND d2 <= 900 GROUP BY 1""")
def class_crossing(pts):
    return graphs.class_crossing(pts, 30.0)


@query(f"""WITH {PTS}, b AS (SELECT pattern_id, floor(x / 100)::INT AS gx, floor(y / 100)::INT AS gy, count(*)::DOUBLE AS m FROM pts GROUP BY 1, 2, 3), z AS (SELECT *, m - avg(m) OVER w AS z, count(*) OVER w AS squares FROM b WINDOW w AS (PARTITION BY pattern_id))
    SELECT z.pattern_id, any_value(z.squares) AS squares, count(*) AS sides, {q('sum((z.z - o.z) * (z.z - o.z))')} AS intrinsic, {q('sum(z.z * z.z + o.z * o.z - 1.8 * z.z * o.z)')} AS autoregressive
    FROM z JOIN z o ON o.pattern_id = z.pattern_id AND ((o.gx = z.gx - 1 AND o.gy = z.gy) OR (o.gx = z.gx AND o.gy = z.gy - 1)) GROUP BY 1""")
def lattice_forms(pts):
    return graphs.lattice_forms(pts, 100.0, 0.9)


@table_query(f"""WITH i AS (SELECT l_orderkey AS edge, l_partkey AS node, l_quantity::DOUBLE AS value FROM lineitem), x AS (SELECT node, avg(value) AS x FROM i GROUP BY 1), d AS (SELECT DISTINCT edge, node FROM i), m AS (SELECT edge, avg(x) AS m FROM d JOIN x USING (node) GROUP BY 1)
    SELECT node::BIGINT AS node, count(*) AS edges, {q('any_value(x) - avg(m)')} AS laplacian FROM d JOIN m USING (edge) JOIN x USING (node) GROUP BY 1""")
def hypergraph_laplacian(t):
    return graphs.hypergraph_laplacian(t("lineitem").select(F.col("l_orderkey").alias("edge"), F.col("l_partkey").cast("long").alias("node"), F.col("l_quantity").cast("double").alias("value")))


# Group comparisons, posteriors, calibration ------------------------------------------------------


@table_query(f"""WITH {_PAT}, a AS (SELECT site, grp = 'BUILDING' AS f, value FROM p), n AS (SELECT site, count(*) FILTER (f) AS n_first, count(*) FILTER (NOT f) AS n_second FROM a GROUP BY 1),
    d AS (SELECT a.site, a.f AS af, b.f AS bf, avg(abs(a.value - b.value)) AS d FROM a JOIN a b ON a.site = b.site GROUP BY 1, 2, 3)
    SELECT site, n_first, n_second, {q('sum(CASE WHEN af <> bf THEN d ELSE -d END)', 3)} AS energy FROM d JOIN n USING (site) WHERE n_first > 0 AND n_second > 0 GROUP BY ALL""")
def energy_distance(t):
    out = groups.energy_distance(_patients(t).select("site", (F.col("grp") == "BUILDING").alias("is_first"), "value"), "site")
    return out.withColumn("energy", F.round("energy", 3))


@table_query(f"""WITH e AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), s AS (SELECT label, pos, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM e GROUP BY 1, 2), r AS (SELECT * FROM s WHERE label = 0)
    SELECT s.label, max(s.n) AS n, {q('sum((s.s / s.n - r.s / r.n) * (s.s / s.n - r.s / r.n))')} AS biased,
      {q('sum((s.s * s.s - s.q) / nullif(s.n * (s.n - 1), 0) + (r.s * r.s - r.q) / nullif(r.n * (r.n - 1), 0) - 2 * s.s * r.s / (s.n * r.n))')} AS unbiased FROM s JOIN r USING (pos) WHERE s.label <> 0 GROUP BY 1""")
def linear_mmd(t):
    return groups.linear_mmd(t("embeddings"), "label", "embedding", 0)


@table_query(f"""WITH {_PAT}, {_WE}, s AS (SELECT site, m0 - m1 AS x, 1 / (v0 / n0 + v1 / n1) AS w FROM w WHERE n0 > 1 AND n1 > 1), a AS (SELECT sum(w) AS tw, sum(w * x) AS twx FROM s)
    SELECT site, {q('(twx - w * x) / (tw - w)')} AS pooled, {q('1 / sqrt(tw - w)')} AS standard_error FROM s, a""")
def leave_one_site_out(t):
    return groups.leave_one_out(cohort.welch(_patients(t), "BUILDING", "MACHINERY", "site"), "site")


@table_query(f"""WITH {_PAT}, f AS (SELECT site, avg(value) AS m, stddev_samp(value) AS s, count(*)::DOUBLE AS n FROM p GROUP BY 1), d AS (SELECT stddev_samp(m) AS dm, stddev_samp(s) AS ds, stddev_samp(n) AS dn FROM f), r AS (SELECT m AS rm, s AS rs, n AS rn FROM f WHERE site = 0)
    SELECT site, {q('sqrt(pow((m - rm) / dm, 2) + pow((s - rs) / ds, 2) + coalesce(pow((n - rn) / nullif(dn, 0), 2), 0))')} AS distance FROM f, d, r""")
def fingerprint_distance(t):
    f = _patients(t).groupBy("site").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    return groups.fingerprint_distance(f, "site", ["m", "s", "n"], 0)


@query(f"""WITH {PTS}, s AS (SELECT pattern_id, label, count(*) FILTER (mark2 = 1) AS n1, count(*) FILTER (mark2 = 0) AS n0, avg(value) FILTER (mark2 = 1) AS m1, avg(value) FILTER (mark2 = 0) AS m0, var_pop(value) FILTER (mark2 = 1) AS v1, var_pop(value) FILTER (mark2 = 0) AS v0
      FROM (SELECT *, (z < 400)::INT AS mark2 FROM pts) GROUP BY 1, 2), a AS (SELECT pattern_id, sum(n1 + n0) AS n, sum((n1 + n0) * (m1 - m0)) AS nt, sum((n1 + n0) * (m1 - m0) * (m1 - m0)) AS ntt, sum((n1 + n0) * (n1 + n0) * (v1 / n1 + v0 / n0)) AS noise FROM s WHERE n1 > 0 AND n0 > 0 GROUP BY 1)
    SELECT pattern_id, n::BIGINT AS n, {q('nt / n')} AS effect, {q('sqrt(ntt - nt * nt / n + noise) / n')} AS standard_error FROM a""")
def stratified_aipw(pts):
    return groups.stratified_aipw(pts.withColumn("treated", (F.col("z") < 400).cast("int")), "pattern_id", "label", "treated", "value")


@query(f"""WITH {PTS}, a AS (SELECT pattern_id, count(*) FILTER (z <> x) AS n, count(*) FILTER (z > x) AS up FROM pts GROUP BY 1), g AS (SELECT unnest([1.0, 1.5, 2.0])::DOUBLE AS g)
    SELECT pattern_id, g AS gamma, n, up, {q('(up - n * g / (1 + g)) / sqrt(n * g / (1 + g) / (1 + g))')} AS z_low, {q('(up - n / (1 + g)) / sqrt(n * g / (1 + g) / (1 + g))')} AS z_high FROM a, g WHERE n > 0""")
def sign_sensitivity(pts):
    return groups.sign_sensitivity(pts, "pattern_id", F.col("z") - F.col("x"), [1.0, 1.5, 2.0])


@query(f"""WITH {PTS}, a AS (SELECT pattern_id, count(value) AS n, sum(value) AS s, 1 / 100.0 + count(value) / 225.0 AS w FROM pts GROUP BY 1)
    SELECT pattern_id, n, {q('(20.0 / 100.0 + s / 225.0) / w')} AS mean, {q('1 / w')} AS variance, {q('ln(w * 100.0) / 2')} AS information FROM a""")
def normal_posterior(pts):
    return groups.normal_posterior(pts, "pattern_id", "value", 20.0, 100.0, 225.0)


@query(f"""WITH {PTS}, c AS (SELECT unnest(['A', 'N', 'R', 'X']) AS class), n AS (SELECT pattern_id, count(*) AS n FROM pts GROUP BY 1), k AS (SELECT pattern_id, label AS class, count(*) AS k FROM pts GROUP BY 1, 2),
    m AS (SELECT pattern_id, class, coalesce(k, 0) AS k, (coalesce(k, 0) + 0.5) / (n + 2.0) AS m, n FROM n CROSS JOIN c LEFT JOIN k USING (pattern_id, class)) SELECT pattern_id, class, k AS count, {q('m')} AS mean, {q('m * (1 - m) / (n + 3.0)')} AS variance FROM m""")
def dirichlet_posterior(pts):
    return groups.dirichlet_posterior(pts, "pattern_id", "label", 0.5, ["A", "N", "R", "X"])


@table_query(f"""WITH {_SC}, r AS (SELECT lang, score, row_number() OVER (PARTITION BY lang ORDER BY score) AS i, count(*) OVER (PARTITION BY lang) AS n FROM s)
    SELECT lang, n, ceil((n + 1) * 0.9 - 1e-9)::BIGINT AS rank, {q('min(score) FILTER (i = ceil((n + 1) * 0.9 - 1e-9))')} AS quantile FROM r GROUP BY 1, 2""")
def conformal_quantiles(t):
    return groups.conformal_quantiles(_scores(t), "lang", "score", 0.1)


@table_query(f"""WITH {_SC}, h AS (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS threshold) SELECT lang, threshold, {q('count(*) FILTER (greatest(score, 1 - score) >= threshold) / count(*)')} AS coverage,
      {q('count(*) FILTER (greatest(score, 1 - score) >= threshold AND (score >= 0.5)::INT <> label) / nullif(count(*) FILTER (greatest(score, 1 - score) >= threshold), 0)')} AS error FROM s, h GROUP BY 1, 2""")
def abstention(t):
    return groups.abstention(_scores(t), "lang", [0.5, 0.7, 0.9])


@table_query(f"""WITH {_SC}, w AS (SELECT unnest(range(11)) / 10.0::DOUBLE AS weight), m AS (SELECT lang, weight, avg(ln(greatest(CASE WHEN label = 1 THEN weight * score + (1 - weight) * 0.6 ELSE 1 - (weight * score + (1 - weight) * 0.6) END, 1e-6))) AS v FROM s, w GROUP BY 1, 2)
    SELECT lang, weight, {q('v')} AS log_score, row_number() OVER (PARTITION BY lang ORDER BY round(v, 9) DESC, weight) = 1 AS selected FROM m""")
def log_score_weights(t):
    return groups.log_score_weights(_scores(t).withColumn("base", F.lit(0.6)), "lang", "score", "base", "label")


# Permutation nulls, local prediction, dynamics ---------------------------------------------------


@table_query(f"""WITH {_NULL}, m AS (SELECT n.replicate, o.site, o.s, max(abs(n.t)) OVER (PARTITION BY n.replicate ORDER BY o.s) AS m FROM nl n JOIN ob o USING (site) WHERE n.replicate > 0), r AS (SELECT site, s, (1 + count(*) FILTER (m >= s)) / (1.0 + count(*)) AS p FROM m GROUP BY 1, 2)
    SELECT site, {q('s')} AS statistic, {q('max(p) OVER (ORDER BY s DESC)')} AS p_adjusted FROM r""")
def step_down_max_t(t):
    return inference.step_down(_null(t), "site")


@query(f"""WITH {PTS}, d AS (SELECT pattern_id, idx, z - x AS d FROM pts), o AS (SELECT pattern_id, count(*) AS n, avg(d) AS m FROM d GROUP BY 1), f AS (SELECT pattern_id, replicate, avg(CASE WHEN {unit(31, 'replicate', 'idx')} < 0.5 THEN d ELSE -d END) AS m FROM d, (SELECT unnest(range(1, 200)) AS replicate) GROUP BY 1, 2)
    SELECT pattern_id, n, {q('o.m')} AS mean, {q('(1 + count(*) FILTER (abs(f.m) >= abs(o.m) - 1e-12)) / 200.0')} AS p FROM o JOIN f USING (pattern_id) GROUP BY pattern_id, n, o.m""")
def paired_sign_flips(pts):
    return inference.sign_flips(pts.withColumn("difference", F.col("z") - F.col("x")), 199, 31, "pattern_id", id_col="idx")


@query(f"""WITH {PTS}, c AS (SELECT l_suppkey::BIGINT AS pattern_id, l_linenumber AS component, avg(l_quantity::DOUBLE) AS m FROM lineitem GROUP BY 1, 2), p AS (SELECT pattern_id, row_number() OVER (PARTITION BY pattern_id ORDER BY component) - 1 AS pos, count(*) OVER (PARTITION BY pattern_id) AS n, m FROM c),
    d AS (SELECT pattern_id, replicate, floor({unit(17, 'replicate', 'pos')} * n)::BIGINT AS pos FROM p, (SELECT unnest(range(1, 200)) AS replicate)), b AS (SELECT pattern_id, replicate, avg(m) AS b FROM d JOIN p USING (pattern_id, pos) GROUP BY 1, 2), o AS (SELECT pattern_id, count(*) AS clusters, avg(m) AS mean FROM p GROUP BY 1)
    SELECT pattern_id, clusters, {q('mean')} AS mean, {q('quantile_cont(b, 0.05)')} AS low, {q('quantile_cont(b, 0.95)')} AS high FROM o JOIN b USING (pattern_id) GROUP BY pattern_id, clusters, mean""")
def cluster_bootstrap(pts):
    return inference.bootstrap_mean(pts, 199, 17, 0.1, "pattern_id", "component")


@query(f"""WITH {PTS}, {PR}, ed AS (SELECT pattern_id, i, j FROM pr WHERE i < j AND d2 <= 900), {shuffle('sl', 'pts', 'pattern_id', 'idx', 'label', 99, 5)}, al AS (SELECT pattern_id, replicate, idx, label FROM sl UNION ALL SELECT pattern_id, 0, idx, label FROM pts),
    k AS (SELECT e.pattern_id, a.replicate, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS k FROM ed e JOIN al a ON a.pattern_id = e.pattern_id AND a.idx = e.i JOIN al b ON b.pattern_id = e.pattern_id AND b.idx = e.j AND b.replicate = a.replicate GROUP BY 1, 2, 3, 4),
    n AS (SELECT DISTINCT pattern_id, label FROM pts), g AS (SELECT x.pattern_id, x.label AS a, y.label AS b, replicate FROM n x JOIN n y ON x.pattern_id = y.pattern_id AND x.label <= y.label, (SELECT unnest(range(100)) AS replicate)),
    f AS (SELECT pattern_id, a, b, replicate, coalesce(k, 0) AS k FROM g LEFT JOIN k USING (pattern_id, a, b, replicate)), o AS (SELECT pattern_id, a, b, k AS seen FROM f WHERE replicate = 0),
    s AS (SELECT pattern_id, a, b, seen, avg(k) AS m, stddev_samp(k) AS sd, count(*) FILTER (k >= seen) AS hits FROM f JOIN o USING (pattern_id, a, b) WHERE replicate > 0 GROUP BY 1, 2, 3, 4)
    SELECT pattern_id, a, b, seen AS edges, {q('m')} AS mean, CASE WHEN m > 0 THEN {q('seen / m')} END AS ratio, CASE WHEN sd > 0 THEN {q('(seen - m) / sd')} END AS z, {q('(1 + hits) / 100.0')} AS p_high FROM s""")
def shuffled_enrichment(pts):
    return inference.shuffled_enrichment(pts, 30.0, 99, 5)


@query(f"""WITH {PTS}, {PR}, ed AS (SELECT pattern_id, i, j FROM pr WHERE i < j AND d2 <= 900), {shuffle('sl', 'pts', 'pattern_id, stratum', 'idx', 'label', 99, 5)}, al AS (SELECT pattern_id, replicate, idx, label FROM sl UNION ALL SELECT pattern_id, 0, idx, label FROM pts),
    k AS (SELECT e.pattern_id, a.replicate, least(a.label, b.label) AS a, greatest(a.label, b.label) AS b, count(*) AS k FROM ed e JOIN al a ON a.pattern_id = e.pattern_id AND a.idx = e.i JOIN al b ON b.pattern_id = e.pattern_id AND b.idx = e.j AND b.replicate = a.replicate GROUP BY 1, 2, 3, 4),
    n AS (SELECT DISTINCT pattern_id, label FROM pts), g AS (SELECT x.pattern_id, x.label AS a, y.label AS b, replicate FROM n x JOIN n y ON x.pattern_id = y.pattern_id AND x.label <= y.label, (SELECT unnest(range(100)) AS replicate)),
    f AS (SELECT pattern_id, a, b, replicate, coalesce(k, 0) AS k FROM g LEFT JOIN k USING (pattern_id, a, b, replicate)), o AS (SELECT pattern_id, a, b, k AS seen FROM f WHERE replicate = 0),
    s AS (SELECT pattern_id, a, b, seen, avg(k) AS m, stddev_samp(k) AS sd, count(*) FILTER (k >= seen) AS hits FROM f JOIN o USING (pattern_id, a, b) WHERE replicate > 0 GROUP BY 1, 2, 3, 4)
    SELECT pattern_id, a, b, seen AS edges, {q('m')} AS mean, CASE WHEN m > 0 THEN {q('seen / m')} END AS ratio, CASE WHEN sd > 0 THEN {q('(seen - m) / sd')} END AS z, {q('(1 + hits) / 100.0')} AS p_high FROM s""")
def stratified_enrichment(pts):
    return inference.shuffled_enrichment(pts, 30.0, 99, 5, stratum="stratum")


@query()
def ordinary_kriging(pts):
    spots = pts.sparkSession.range(25).select(F.col("id").alias("idx"), ((F.col("id") % 5) * 200.0 + 100).alias("x"), (F.floor(F.col("id") / 5) * 200.0 + 100).alias("y"))
    targets = pts.select("pattern_id").distinct().crossJoin(F.broadcast(spots))  # 25 fixed spots a pattern
    return inference.kriging(pts, targets, 150.0, 8, 200.0, 80.0, 10.0)


@query(f"""WITH {PTS}, n AS (SELECT pattern_id, count(*) AS n FROM pts GROUP BY 1), h AS (SELECT m, sum(CASE WHEN m > 0 THEN 1.0 / m ELSE 0 END) OVER (ORDER BY m) AS h FROM (SELECT unnest(range((SELECT max(n) FROM n))) AS m)),
    e AS (SELECT a.pattern_id, a.idx, a.value AS v, a.z, list_extract(min(greatest(abs(a.value - b.value), abs(a.z - b.z)), 3), 3) AS e FROM pts a JOIN pts b ON a.pattern_id = b.pattern_id AND a.idx <> b.idx GROUP BY ALL),
    c AS (SELECT e.pattern_id, e.idx, count(*) FILTER (abs(e.v - b.value) < e) AS nx, count(*) FILTER (abs(e.z - b.z) < e) AS ny FROM e JOIN pts b ON e.pattern_id = b.pattern_id AND e.idx <> b.idx GROUP BY 1, 2),
    s AS (SELECT pattern_id, avg(a.h + b.h) AS s FROM c JOIN h a ON a.m = nx JOIN h b ON b.m = ny GROUP BY 1) SELECT pattern_id, n, CASE WHEN n > 3 THEN {q('1.5 + h - s')} END AS information FROM n LEFT JOIN s USING (pattern_id) JOIN h ON m = n - 1""")
def neighbour_information(pts):
    return inference.neighbour_information(pts, "value", "z", 3)


@query(f"""WITH RECURSIVE {PTS}, {PR}, rr AS (SELECT unnest([10.0, 20.0, 30.0, 40.0, 50.0])::DOUBLE AS r), li AS MATERIALIZED (SELECT pattern_id, r, i, j FROM pr, rr WHERE d2 <= r * r), nd AS MATERIALIZED (SELECT pattern_id, r, idx AS i FROM pts, rr),
    la(pattern_id, r, i, c) USING KEY (pattern_id, r, i) AS (SELECT pattern_id, r, i, i FROM nd UNION SELECT l.pattern_id, l.r, l.i, min(w.c) FROM li l JOIN la w ON w.pattern_id = l.pattern_id AND w.r = l.r AND w.i = l.j JOIN recurring.la o ON o.pattern_id = l.pattern_id AND o.r = l.r AND o.i = l.i WHERE w.c < o.c GROUP BY 1, 2, 3),
    k AS (SELECT pattern_id, r, c, count(*) AS k FROM la GROUP BY 1, 2, 3) SELECT pattern_id, r, count(*) AS components, {q('max(k) / sum(k)')} AS largest_share FROM k GROUP BY 1, 2""")
def connectivity_transition(pts):
    return inference.merge_curve(pts, [10.0, 20.0, 30.0, 40.0, 50.0])


@table_query(f"""WITH {_PAT}, u AS (SELECT grp, site, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM p GROUP BY 1, 2),
    a AS (SELECT sum(n * m) / sum(n) AS g, sum(ss) / (sum(n) - count(*)) AS w, sum(n * m * m) - sum(n * m) * (sum(n * m) / sum(n)) AS b, count(*) AS k, sum(n) - sum(n * n) / sum(n) AS d FROM u), v AS (SELECT g, w, greatest(0.0, (b - (k - 1) * w) / d) AS t FROM a)
    SELECT grp || '_' || site AS unit, n, {q('m', 3)} AS mean, {q('n * t / (n * t + w)')} AS weight, {q('g + n * t / (n * t + w) * (m - g)', 3)} AS shrunken FROM u, v""")
def hierarchical_means(t):
    rows = _patients(t).select(F.concat_ws("_", "grp", "site").alias("unit"), "value")
    return inference.shrunken_means(rows, "unit").withColumns({c: F.round(c, 3) for c in ("mean", "shrunken")})


_LEAPS = "SELECT *, t AS u, p + step * ((20.0 - t) / 100 + (s - n * t) / 225) / 2 AS v FROM d"
for _k in range(6):
    _LEAPS = f"SELECT * REPLACE (v + step * ((20.0 - u) / 100 + (s - n * u) / 225) * {1.0 if _k < 5 else 0.5} AS v) FROM (SELECT * REPLACE (u + step * v AS u) FROM ({_LEAPS}))"
_ENERGY = "(pow({0} - 20.0, 2) / 200 + (n * {0} * {0} - 2 * s * {0}) / 450)"


@query(f"""WITH RECURSIVE {PTS}, su AS (SELECT pattern_id, count(*)::DOUBLE AS n, sum(value)::DOUBLE AS s FROM pts GROUP BY 1), dr AS MATERIALIZED (SELECT pattern_id, k AS replicate, {normal_sql(3, 'replicate', 'pattern_id').replace('(replicate)', '(k)')} AS p, ln({unit(5, 'replicate', 'pattern_id').replace('(replicate)', '(k)')}) AS e FROM su, (SELECT unnest(range(1, 201)) AS k)),
    ch AS (SELECT pattern_id, n, s, 0 AS k, 20.0::DOUBLE AS t, 0 AS took, 0.3 / sqrt(0.01 + n / 225) AS step FROM su UNION ALL SELECT pattern_id, n, s, k + 1, CASE WHEN ok THEN u ELSE t END, ok::INT, step FROM (SELECT *, e < {_ENERGY.format('t')} + p * p / 2 - {_ENERGY.format('u')} - v * v / 2 AS ok FROM ({_LEAPS.replace('FROM d', "FROM (SELECT c.pattern_id, c.n, c.s, c.k, c.t, c.step, r.p, r.e FROM ch c JOIN dr r ON r.pattern_id = c.pattern_id AND r.replicate = c.k + 1)")})))
    SELECT pattern_id, n::BIGINT AS n, {q('avg(t) FILTER (k > 40)')} AS mean, {q('stddev_pop(t) FILTER (k > 40)')} AS deviation, {q('sum(took) FILTER (k > 0) / 200.0')} AS acceptance FROM ch GROUP BY pattern_id, n""")
def hamiltonian_mean(pts):
    s = pts.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    return inference.hamiltonian_mean(s, "pattern_id", 20.0, 100.0, 225.0, 200, 3)


_C = [(1 if k == 0 else 2) * (-1) ** k * dynamics._bessel(k, 1.0) * 2.718281828459045**-1 for k in range(4)]
_STEP = "SELECT e.pattern_id, e.i AS idx, sum(e.w * s.v) AS m FROM e JOIN {0} s ON s.pattern_id = e.pattern_id AND s.idx = e.j GROUP BY 1, 2"


@query(f"""WITH {PTS}, {PR}, e0 AS MATERIALIZED (SELECT pattern_id, i, j FROM pr WHERE d2 <= 900), g AS (SELECT pattern_id, i, count(*) AS deg FROM e0 GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT e0.pattern_id, e0.i, e0.j, -1 / sqrt(a.deg * b.deg) AS w FROM e0 JOIN g a ON a.pattern_id = e0.pattern_id AND a.i = e0.i JOIN g b ON b.pattern_id = e0.pattern_id AND b.i = e0.j),
    t0 AS MATERIALIZED (SELECT pattern_id, idx, value AS v FROM pts), m1 AS ({_STEP.format('t0')}), t1 AS MATERIALIZED (SELECT pattern_id, idx, coalesce(m, 0) AS v FROM t0 LEFT JOIN m1 USING (pattern_id, idx)),
    m2 AS ({_STEP.format('t1')}), t2 AS MATERIALIZED (SELECT pattern_id, idx, 2 * coalesce(m, 0) - t0.v AS v FROM t0 LEFT JOIN m2 USING (pattern_id, idx)),
    m3 AS ({_STEP.format('t2')}), t3 AS (SELECT pattern_id, idx, 2 * coalesce(m, 0) - t1.v AS v FROM t1 LEFT JOIN m3 USING (pattern_id, idx))
    SELECT pattern_id, idx, {q(f'{_C[0]!r} * t0.v + {_C[1]!r} * t1.v + {_C[2]!r} * t2.v + {_C[3]!r} * t3.v')} AS heat FROM t0 JOIN t1 USING (pattern_id, idx) JOIN t2 USING (pattern_id, idx) JOIN t3 USING (pattern_id, idx)""")
def chebyshev_heat(pts):
    return dynamics.chebyshev_heat(pts, 30.0, 1.0, 3)


@table_query(f"""WITH RECURSIVE s AS (SELECT s_suppkey::BIGINT AS key, 0.5 + s_suppkey % 5 / 10.0 AS r, 0.5 + s_suppkey % 3 / 4.0 AS d FROM supplier),
    st AS (SELECT key, r::DOUBLE AS r, d::DOUBLE AS d, 0 AS n, list_transform(range(80), lambda i: CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS u FROM s UNION ALL SELECT key, r, d, n + 1, list_transform(u, lambda v, i: v + 0.1 * (d * (coalesce(u[i + 1], v) - 2 * v + CASE WHEN i = 1 THEN v ELSE u[i - 1] END) + r * v * (1 - v))) FROM st WHERE n < 200)
    SELECT key, coalesce(list_max(list_filter(list_transform(u, lambda v, i: CASE WHEN v >= 0.5 THEN i - 1 END), lambda v: v IS NOT NULL)), 0)::DOUBLE AS front, {q('list_sum(u)')} AS total FROM st WHERE n = 200""")
def growth_front(t):
    s = t("supplier").select(F.col("s_suppkey").alias("key"), (0.5 + F.col("s_suppkey") % 5 / 10).alias("rate"), (0.5 + F.col("s_suppkey") % 3 / 4).alias("diffusion"))
    return dynamics.growth_front(s, 80, 1.0, 0.1, 200)


@table_query(f"""WITH RECURSIVE s AS (SELECT s_suppkey::BIGINT AS key, 0.5 + s_suppkey % 7 / 5.0 AS a, 0.5 + s_suppkey % 4 / 3.0 AS b, (0.1 + s_suppkey % 3 / 10.0)::DOUBLE AS x, (0.1 + s_suppkey % 5 / 10.0)::DOUBLE AS y, 0 AS n FROM supplier
    UNION ALL SELECT key, a, b, x + 0.05 / 6 * (k1 + 2 * k2 + 2 * k3 + p * (1 - p - a * r)), y + 0.05 / 6 * (l1 + 2 * l2 + 2 * l3 + r * (1 - r - b * p)), n + 1 FROM (SELECT *, x + 0.05 * k3 AS p, y + 0.05 * l3 AS r FROM (SELECT *, p2 * (1 - p2 - a * r2) AS k3, r2 * (1 - r2 - b * p2) AS l3 FROM (SELECT *, x + 0.025 * k2 AS p2, y + 0.025 * l2 AS r2
      FROM (SELECT *, p1 * (1 - p1 - a * r1) AS k2, r1 * (1 - r1 - b * p1) AS l2 FROM (SELECT *, x + 0.025 * k1 AS p1, y + 0.025 * l1 AS r1 FROM (SELECT *, x * (1 - x - a * y) AS k1, y * (1 - y - b * x) AS l1 FROM s WHERE n < 400)))))))
    SELECT key, {q('x')} AS x, {q('y')} AS y FROM s WHERE n = 400""")
def competition(t):
    k = F.col("s_suppkey")
    return dynamics.competition(t("supplier").select(k.alias("key"), (0.5 + k % 7 / 5).alias("a"), (0.5 + k % 4 / 3).alias("b"), (0.1 + k % 3 / 10).alias("x"), (0.1 + k % 5 / 10).alias("y")), 0.05, 400)


@table_query()
def particle_filter(t):
    e = t("events").select(F.col("user_id").cast("long").alias("series"), F.col("event_id").cast("long").alias("t"), F.col("value").cast("double"))
    return dynamics.particle_filter(e, 0.9, 1.0, 4.0, 0.0, 10.0, 200, 9)


@table_query(f"""WITH c AS (SELECT o_custkey % 50 AS key, month(o_orderdate) / 12.0::DOUBLE AS t, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2), m AS (SELECT key, count(*) AS n, sum(t * t) AS tt, sum(t * ln(value)) AS tv, sum(ln(value) * ln(value)) AS vv FROM c GROUP BY 1),
    d AS (SELECT 1.0 + 7.0 * (i * 0.6180339887498949::DOUBLE - floor(i * 0.6180339887498949::DOUBLE)) AS r FROM (SELECT unnest(range(1, 201))::DOUBLE AS i)), k AS (SELECT key, CASE WHEN sqrt(greatest(0, r * r * tt - 2 * r * tv + vv) / n) <= 1.6 THEN r END AS r FROM m, d)
    SELECT key::BIGINT AS key, count(r) AS accepted, {q('avg(r)')} AS mean, {q('min(r)')} AS least, {q('max(r)')} AS most FROM k GROUP BY 1""")
def rejection_growth(t):
    curves = t("orders").groupBy((F.col("o_custkey") % 50).cast("long").alias("key"), (F.month("o_orderdate") / 12.0).alias("t")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return dynamics.rejection_growth(curves, 1.0, 8.0, 200, 1.6)


# Spectra -----------------------------------------------------------------------------------------


@query()
def permuted_spectrum(pts):
    return spectra.permuted_spectrum(pts, 1000.0, 0.006, 0.045, 6, 99, 4)


@query()
def spectrum_readouts(pts):
    return spectra.spectrum_readouts(pts, 1000.0, 0.006, 0.045, 6, 2, 99, 4)


@query()
def stratified_spectrum_readouts(pts):
    return spectra.spectrum_readouts(pts, 1000.0, 0.006, 0.045, 6, 2, 99, 4, stratum="stratum")


_TAPER = "(0.5 - 0.5 * cos(2 * pi() * {0} / 31))"


@query(f"""WITH {PTS}, m AS (SELECT pattern_id, avg(mark) AS m FROM pts GROUP BY 1), ra AS (SELECT pattern_id, least(floor(x / 31.25), 31)::INT AS gx, least(floor(y / 31.25), 31)::INT AS gy, sum(mark - m) * {_TAPER.format('least(floor(any_value(x) / 31.25), 31)')} * {_TAPER.format('least(floor(any_value(y) / 31.25), 31)')} AS v FROM pts JOIN m USING (pattern_id) GROUP BY 1, 2, 3),
    fq AS (SELECT unnest(range(32))::INT AS f), fa AS (SELECT pattern_id, f AS u, gy, sum(v * cos(2 * pi() * f * gx / 32)) AS c, -sum(v * sin(2 * pi() * f * gx / 32)) AS s FROM ra, fq GROUP BY 1, 2, 3),
    fb AS (SELECT pattern_id, u, f AS w, sum(c * cos(2 * pi() * f * gy / 32) + s * sin(2 * pi() * f * gy / 32)) AS c, sum(s * cos(2 * pi() * f * gy / 32) - c * sin(2 * pi() * f * gy / 32)) AS s FROM fa, fq GROUP BY 1, 2, 3),
    tp AS (SELECT sum(pow({_TAPER.format('a')}, 2)) AS t FROM (SELECT unnest(range(32)) AS a)), po AS (SELECT pattern_id, 2 * pi() / 1000 * sqrt(pow(CASE WHEN u >= 16 THEN u - 32 ELSE u END, 2) + pow(CASE WHEN w >= 16 THEN w - 32 ELSE w END, 2)) AS k, (c * c + s * s) / (t * t) AS p FROM fb, tp),
    an AS (SELECT *, least(floor(k / (pi() * 32 / 1000 / 8) + 1e-9), 7)::BIGINT AS annulus FROM po WHERE k > 0 AND k <= pi() * 32 / 1000 + 1e-12)
    SELECT pattern_id, annulus, count(*) AS modes, {q('avg(k)')} AS k, {q('avg(p)')} AS power FROM an GROUP BY 1, 2""")
def raster_periodogram(pts):
    return spectra.periodogram(pts, 1000.0, 32, 8)


@query(f"""WITH {PTS}, {PR}, s AS (SELECT unnest([15.0, 30.0])::DOUBLE AS scale), p AS (SELECT pattern_id, avg(mark) AS p FROM pts GROUP BY 1), u AS (SELECT pattern_id, i, jm, jx, jy, d2 FROM pr WHERE im = 1 UNION ALL SELECT pattern_id, idx, mark, x, y, 0 FROM pts WHERE mark = 1),
    d AS (SELECT pattern_id, i AS idx, scale, count(*) AS n, sum(jm)::BIGINT AS marked, avg(jx) FILTER (jm = 1) AS cx, avg(jy) FILTER (jm = 1) AS cy FROM u, s WHERE d2 <= 2 * scale * scale GROUP BY 1, 2, 3)
    SELECT pattern_id, idx, scale, n, marked, {q('cx')} AS cx, {q('cy')} AS cy, {q('(marked / n - p) / sqrt(p * (1 - p) / n + 1e-9)')} AS z FROM d JOIN p USING (pattern_id)""")
def residual_discs(pts):
    return spectra.residual_discs(pts, [15.0, 30.0])


@query()
def residual_territories(pts):
    return spectra.residual_territories(pts, [15.0, 30.0], 2.0)


@query(f"""WITH {PTS}, m AS (SELECT pattern_id, stratum, floor(x / 100) * 100 AS axis, avg(value) AS v FROM pts GROUP BY 1, 2, 3), a AS (SELECT * FROM m WHERE stratum = 'F'), b AS (SELECT * FROM m WHERE stratum = 'O')
    SELECT pattern_id, axis::DOUBLE AS axis, {q('a.v')} AS before, {q('b.v')} AS after, {q('b.v - a.v')} AS delta, abs(b.v - a.v) <= 5 AS within FROM a FULL JOIN b USING (pattern_id, axis)""")
def paired_deltas(pts):
    m = pts.groupBy("pattern_id", "stratum", (F.floor(F.col("x") / 100) * 100.0).alias("axis")).agg(F.avg("value").alias("v"))
    return spectra.paired_deltas(m.where("stratum = 'F'"), m.where("stratum = 'O'"), ["pattern_id", "axis"], "v", 5.0)


# Clusters, curves, matrices, tables --------------------------------------------------------------


@query(f"""WITH c AS (SELECT l_suppkey::BIGINT AS pattern_id, l_linenumber AS component, l_linenumber <= 3 AS g, avg(l_quantity::DOUBLE) AS m FROM lineitem GROUP BY 1, 2), {shuffle('sg', 'c', 'pattern_id', 'component', 'g', 199, 21)},
    e AS (SELECT pattern_id, 0 AS replicate, g, m FROM c UNION ALL SELECT pattern_id, replicate, sg.g, m FROM sg JOIN (SELECT pattern_id, component, m FROM c) USING (pattern_id, component)), s AS (SELECT pattern_id, replicate, count(*) AS n, avg(m) FILTER (g) - avg(m) FILTER (NOT g) AS d FROM e GROUP BY 1, 2), o AS (SELECT pattern_id, n AS clusters, d AS seen FROM s WHERE replicate = 0)
    SELECT pattern_id, clusters, {q('seen')} AS difference, CASE WHEN seen IS NOT NULL THEN {q('(1 + count(*) FILTER (abs(d) >= abs(seen) - 1e-12)) / 200.0')} END AS p FROM o JOIN s USING (pattern_id) WHERE replicate > 0 GROUP BY pattern_id, clusters, seen""")
def cluster_permutation(pts):
    return inference.cluster_permutation(pts.withColumn("is_first", F.col("component") <= 3), 199, 21, "pattern_id", "component")


@table_query(f"""WITH u AS (SELECT o_orderpriority AS endpoint, o_custkey % 20 AS unit, o_custkey % 20 < 10 AS g, {', '.join(f"count(*) FILTER (quarter(o_orderdate) = {k})::DOUBLE AS v{k}" for k in range(1, 5))} FROM orders GROUP BY 1, 2, 3), {shuffle('sg', 'u', 'endpoint', 'unit', 'g', 199, 23)},
    e AS (SELECT endpoint, 0 AS replicate, g, v1, v2, v3, v4 FROM u UNION ALL SELECT endpoint, replicate, sg.g, v1, v2, v3, v4 FROM sg JOIN (SELECT endpoint, unit, v1, v2, v3, v4 FROM u) USING (endpoint, unit)),
    d AS (SELECT endpoint, replicate, count(*) AS n, {', '.join(f"pow(avg(v{k}) FILTER (g) - avg(v{k}) FILTER (NOT g), 2) AS d{k}" for k in range(1, 5))} FROM e GROUP BY 1, 2), s AS (SELECT endpoint, replicate, n, d1 / 2 + d2 + d3 + d4 / 2 AS l FROM d), o AS (SELECT endpoint, n AS units, l AS seen FROM s WHERE replicate = 0)
    SELECT endpoint, units, {q('seen')} AS statistic, {q('(1 + count(*) FILTER (l >= seen - 1e-12)) / 200.0')} AS p FROM o JOIN s USING (endpoint) WHERE replicate > 0 GROUP BY endpoint, units, seen""")
def functional_permutation(t):
    quarter = lambda k: F.struct(F.lit(float(k)).alias("axis"), F.count(F.when(F.quarter("o_orderdate") == k, 1)).cast("double").alias("value"))
    curves = t("orders").groupBy(F.col("o_orderpriority").alias("endpoint"), (F.col("o_custkey") % 20).cast("long").alias("unit")).agg(F.array(*map(quarter, range(1, 5))).alias("curve"))
    curves = curves.select("endpoint", "unit", F.inline("curve"))
    return inference.functional_permutation(curves.withColumn("is_first", F.col("unit") < 10), 199, 23)


@query(f"""WITH {PTS}, {shuffle('sv', 'pts', 'pattern_id', 'idx', 'value, z', 19, 27)}, al AS MATERIALIZED (SELECT pattern_id, 0 AS replicate, idx, x, y, value AS v, z AS w FROM pts UNION ALL SELECT s.pattern_id, s.replicate, s.idx, p.x, p.y, s.value, s.z FROM sv s JOIN (SELECT pattern_id, idx, x, y FROM pts) p USING (pattern_id, idx)), n AS (SELECT pattern_id, count(*) AS n FROM pts GROUP BY 1),
    r AS (SELECT a.pattern_id, a.replicate, corr(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), sqrt((a.v - b.v) * (a.v - b.v) + (a.w - b.w) * (a.w - b.w))) AS r FROM al a JOIN al b ON a.pattern_id = b.pattern_id AND a.replicate = b.replicate AND a.idx < b.idx GROUP BY 1, 2), o AS (SELECT pattern_id, r AS seen FROM r WHERE replicate = 0)
    SELECT n.pattern_id, n, {q('any_value(seen)')} AS r, CASE WHEN count(seen) > 0 THEN {q('(1 + count(*) FILTER (r.r >= seen - 1e-12)) / 20.0')} END AS p FROM n LEFT JOIN o USING (pattern_id) LEFT JOIN (SELECT * FROM r WHERE replicate > 0) r USING (pattern_id) GROUP BY 1, 2""")
def mantel_association(pts):
    return inference.mantel(pts, ["x", "y"], ["value", "z"], 19, 27)


@query()
def process_regression(pts):
    return inference.process_regression(pts, 50.0, 150.0, 60.0)


@query()
def graph_signal_spectrum(pts):
    return graphs.signal_spectrum(pts, 30.0, 8)


@query()
def hodge_parts(pts):
    return graphs.hodge_parts(pts, 30.0)


@table_query("""WITH f AS (SELECT o_orderpriority AS level, min(o_orderkey) AS f, count(*) AS n FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1) SELECT level, (row_number() OVER (ORDER BY f, level) - 1)::INT AS code, n FROM f""")
def stratum_codebook(t):
    return tables.codebook(t("orders"), "o_orderpriority", "o_orderkey")


@table_query("""SELECT doc_id, lang, quality FROM (SELECT doc_id, lang FROM documents) JOIN labels USING (doc_id)""")
def matched_labels(t):
    labels = t("labels").select("doc_id", "quality")
    return tables.matched(t("documents").select("doc_id", "lang").join(labels.select("doc_id"), "doc_id", "left_semi"), labels, ["doc_id"])


@query(f"""WITH {PTS}, b AS (SELECT (a.v * 10 + c.v)::BIGINT AS box, a.v * 90.0 AS x0, c.v * 90.0 AS y0, a.v * 90.0 + 150 AS x1, c.v * 90.0 + 150 AS y1 FROM (SELECT unnest(range(10)) AS v) a, (SELECT unnest(range(10)) AS v) c)
    SELECT pattern_id, idx, box FROM pts, b WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1""")
def contained_patches(pts):
    n = F.col("id")
    boxes = pts.sparkSession.range(100).select(n.alias("box"), (F.floor(n / 10) * 90.0).alias("x0"), (n % 10 * 90.0).alias("y0"), (F.floor(n / 10) * 90.0 + 150).alias("x1"), (n % 10 * 90.0 + 150).alias("y1"))
    return tables.contained(pts, pts.select("pattern_id").distinct().crossJoin(F.broadcast(boxes)), 100.0)  # 100 fixed boxes a pattern


@query(f"""WITH {PTS}, c AS (SELECT pattern_id, floor(x / 50)::BIGINT AS bin, avg(value) AS v FROM pts GROUP BY 1, 2) SELECT pattern_id, bin, {q('v')} AS v, CASE WHEN count(v) OVER w = 3 THEN {q('avg(v) OVER w')} END AS rolled FROM c WINDOW w AS (PARTITION BY pattern_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def rolling_curve(pts):
    return tables.rolling_mean(pts.groupBy("pattern_id", F.floor(F.col("x") / 50).alias("bin")).agg(F.avg("value").alias("v")), 3, "pattern_id", "bin", "v")


@table_query(f"""WITH p AS (SELECT event_type, event_id % 1000 AS mz, sum(abs(value)) AS i FROM events GROUP BY 1, 2), r AS (SELECT event_type, mz, sqrt(i) AS r FROM p WHERE mz >= 100 AND mz < 900),
    s AS (SELECT event_type, mz, greatest(0, coalesce((-3 * lag(r, 2) OVER w + 12 * lag(r) OVER w + 17 * r + 12 * lead(r) OVER w - 3 * lead(r, 2) OVER w) / 35, r)) AS s FROM r WINDOW w AS (PARTITION BY event_type ORDER BY mz))
    SELECT event_type, mz, {q('s / nullif(sum(s) OVER (PARTITION BY event_type), 0)')} AS intensity FROM s""")
def preprocessed_spectrum(t):
    peaks = t("events").groupBy("event_type", (F.col("event_id") % 1000).alias("mz")).agg(F.sum(F.abs("value")).alias("i"))
    return tables.preprocessed_spectrum(peaks, 100, 900, "mz", "i", "event_type")


@query(f"""WITH {PTS}, k AS (SELECT pattern_id, label, stratum, count(*) AS k FROM pts GROUP BY 1, 2, 3), p AS (SELECT label, stratum, sum(k) AS pk FROM k GROUP BY 1, 2), t AS (SELECT sum(pk) AS pn, count(*) AS cells FROM p), n AS (SELECT pattern_id, sum(k) AS n FROM k GROUP BY 1),
    d AS (SELECT pattern_id, n, (coalesce(k, 0) + 0.5) / (n + 0.5 * cells) AS p, (pk + 0.5) / (pn + 0.5 * cells) AS q FROM n CROSS JOIN t CROSS JOIN p LEFT JOIN k USING (pattern_id, label, stratum))
    SELECT pattern_id, max(n)::BIGINT AS n, {q('sum(p * log2(p / q))')} AS divergence FROM d GROUP BY 1""")
def unit_divergence(pts):
    return tables.unit_divergence(pts, "pattern_id", ["label", "stratum"], 0.5)


@query(f"""WITH {PTS}, u AS (SELECT pattern_id, count(*)::DOUBLE AS n, sum(mark)::DOUBLE AS k FROM pts GROUP BY 1), a AS (SELECT count(*) AS m, sum(n) AS nn, sum(n * n) AS n2, sum(k) / sum(n) AS s, sum(k * k / n) AS kk2 FROM u),
    r AS (SELECT s, greatest(0, least(1, (kk2 - nn * s * s - s * (1 - s) * (m - 1)) / (s * (1 - s) * (nn - n2 / nn - (m - 1))))) AS rho FROM a), w AS (SELECT *, n * rho / (1 + (n - 1) * rho) AS w FROM u, r)
    SELECT pattern_id, n::BIGINT AS trials, {q('k / n')} AS share, {q('w')} AS weight, {q('s + w * (k / n - s)')} AS pooled FROM w""")
def beta_binomial_means(pts):
    return groups.beta_binomial_means(pts.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("k")), "pattern_id")


@table_query(f"""WITH t AS (SELECT o_orderpriority AS family, o_orderstatus AS test, count(*) FILTER (o_totalprice > 150000) / count(*)::DOUBLE AS p FROM orders GROUP BY 1, 2), f AS (SELECT family, coalesce(max(top) OVER (ORDER BY family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gate FROM (SELECT family, max(p) AS top FROM t GROUP BY 1))
    SELECT family, test, {q('p')} AS p, {q('greatest(p, gate)')} AS p_adjusted FROM t JOIN f USING (family)""")
def serial_gatekeeping(t):
    rows = t("orders").groupBy(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("test")).agg((F.count(F.when(F.col("o_totalprice") > 150000, 1)) / F.count(F.lit(1))).alias("p"))
    return groups.gatekept(rows, "family")


@query(f"""WITH {PTS}, p AS (SELECT pattern_id, {poisson_sql(1e-4 * 1096.0 * 1096.0, 33, 'pattern_id')} AS n FROM (SELECT DISTINCT pattern_id FROM pts)), a AS (SELECT pattern_id, unnest(range(n)) AS parent FROM p), b AS (SELECT pattern_id, parent, {poisson_sql(5.0, 34, 'pattern_id', 'parent')} AS n FROM a), c AS (SELECT pattern_id, parent, unnest(range(n)) AS child FROM b),
    o AS (SELECT pattern_id, (parent * 1048576 + child)::BIGINT AS idx, -48 + 1096 * {unit(35, 'pattern_id', 'parent')} + 12 * {normal_sql(37, 'pattern_id', 'parent', 'child')} AS x, -48 + 1096 * {unit(36, 'pattern_id', 'parent')} + 12 * {normal_sql(39, 'pattern_id', 'parent', 'child')} AS y FROM c) SELECT pattern_id, idx, {q('x')} AS x, {q('y')} AS y FROM o WHERE x BETWEEN 0 AND 1000 AND y BETWEEN 0 AND 1000""")
def thomas_simulation(pts):
    return models.cluster_points(pts.select("pattern_id").distinct(), WINDOW, 1e-4, 5.0, 12.0, 33)


@table_query(transport_sql("(5.0 / 6.0)", "ln(m)", "ln(m)"))
def unbalanced_transport(t):
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    mass = s.groupBy(F.col("n_regionkey").cast("long").alias("problem"), F.col("n_nationkey").cast("long").alias("nation")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    costs = mass.withColumnsRenamed({"nation": "source", "m": "a"}).join(mass.withColumnsRenamed({"nation": "target", "m": "b"}), "problem")
    return models.unbalanced_sinkhorn(costs.withColumn("cost", F.abs(F.col("source") - F.col("target")).cast("double")), 1.0, 5.0, 500)
