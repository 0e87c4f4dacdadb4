"""The operators as queries over the driver's tables, whole tables each, and their SQL.

The tables have no coordinates: line items become points of one pattern per supplier, which keeps
patterns about as large at any scale; their places are integer arithmetic, so every engine agrees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import benjamini_hochberg, envelope, plus_one_p
from ..functions.draws import poisson_steps
from ..operators import cohort, embedding, models, neighbourhood, point_process, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WINDOW, AREA, RADII, R = (0.0, 0.0, 1000.0, 1000.0), "1000000.0", [15.0, 30.0, 50.0], 50
B = "least(x, 1000.0 - x, y, 1000.0 - y)"
BI = "least(ix, 1000.0 - ix, iy, 1000.0 - iy)"
PTS = """pts AS (SELECT l_suppkey::BIGINT AS pattern_id, (((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 64 + l_quantity::BIGINT)::BIGINT AS idx,
  ((l_partkey * 37 + l_orderkey * 17) % 1000)::DOUBLE AS x, ((l_orderkey * 61 + l_linenumber * 211 + l_partkey * 7) % 1000)::DOUBLE AS y,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS mark, l_returnflag AS label, l_linestatus AS stratum, l_quantity::DOUBLE AS value, ((l_partkey * 11 + l_orderkey * 3) % 1000)::DOUBLE AS z,
  (l_discount * 5)::DOUBLE AS pa, (l_tax * 5)::DOUBLE AS pb, (1 - l_discount * 5 - l_tax * 5)::DOUBLE AS pc FROM lineitem)"""
PR = f"""pr AS (SELECT a.pattern_id, a.idx AS i, b.idx AS j, a.x AS ix, a.y AS iy, b.x AS jx, b.y AS jy, a.label AS il, b.label AS jl,
  a.value AS iv, b.value AS jv, a.mark AS im, b.mark AS jm, a.pa AS ipa, b.pa AS jpa, a.pb AS ipb, b.pb AS jpb, a.pc AS ipc, b.pc AS jpc, a.z AS iz, b.z AS jz,
  (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pts a JOIN pts b ON a.pattern_id = b.pattern_id
  WHERE a.idx <> b.idx AND abs(a.x - b.x) <= {R} AND abs(a.y - b.y) <= {R} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {R * R})"""
RS = "rs AS (SELECT unnest([15.0, 30.0, 50.0])::DOUBLE AS r)"
BASE = f"WITH {PTS}, {PR}, {RS}"


def draw(seed: int, *columns: str) -> str:
    """The SQL of functions.draws.key."""
    return f"md5(concat_ws(':', '{seed}', {', '.join(f'({c})::VARCHAR' for c in columns)}))"


def unit(seed: int, *columns: str) -> str:
    """The SQL of functions.draws.uniform."""
    return f"((('0x' || substr({draw(seed, *columns)}, 1, 8))::BIGINT + 0.5) / 4294967296.0)"


def normal_sql(seed: int, *columns: str) -> str:
    """The SQL of functions.draws.normal."""
    return f"(sqrt(-2 * ln({unit(seed, *columns)})) * cos(2 * pi() * {unit(seed + 1, *columns)}))"


def poisson_sql(mean: float, seed: int, *columns: str) -> str:
    """The SQL of functions.draws.poisson."""
    u, steps = unit(seed, *columns), ", ".join(f"{c!r}::DOUBLE" for c in poisson_steps(mean))
    return f"len(list_filter([{steps}], lambda c: c < {u}))"


def shuffle(name: str, source: str, within: str, ids: str, values: str, n: int, seed: int) -> str:
    """The SQL of functions.draws.shuffled: a CTE with within, ids, replicate, values."""
    key = draw(seed, "replicate", *ids.split(", "))
    return f"""{name}_p AS (SELECT {within}, {ids}, row_number() OVER (PARTITION BY {within} ORDER BY {ids}) AS place FROM {source}),
    {name}_d AS (SELECT {within}, replicate, {values}, row_number() OVER (PARTITION BY {within}, replicate ORDER BY {key}, {ids}) AS place FROM {source}, (SELECT unnest(range(1, {n + 1})) AS replicate)),
    {name} AS (SELECT {within}, {ids}, replicate, {values} FROM {name}_d JOIN {name}_p USING ({within}, place))"""


def q(expr: str, digits: int = 6) -> str:
    """Rounded just off the ties that ratios of small numbers land on; 0.0 has no sign."""
    return f"(round({expr} + 3.7e-9, {digits}) + 0.0)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    c, d = F.col, lambda e: e.cast("double")
    return t.select(
        c("l_suppkey").cast("long").alias("pattern_id"), (((c("l_orderkey").cast("long") * 8 + c("l_linenumber")) * 1000000 + c("l_partkey")) * 64 + c("l_quantity").cast("long")).alias("idx"),
        d((c("l_partkey") * 37 + c("l_orderkey") * 17) % 1000).alias("x"), d((c("l_orderkey") * 61 + c("l_linenumber") * 211 + c("l_partkey") * 7) % 1000).alias("y"),
        F.when(c("l_returnflag") == "R", 1).otherwise(0).alias("mark"), c("l_returnflag").alias("label"), c("l_linestatus").alias("stratum"), d(c("l_quantity")).alias("value"),
        d(c("l_discount") * 5).alias("pa"), d(c("l_tax") * 5).alias("pb"), d(1 - c("l_discount") * 5 - c("l_tax") * 5).alias("pc"), c("l_linenumber").cast("int").alias("component"), d((c("l_partkey") * 11 + c("l_orderkey") * 3) % 1000).alias("z"),
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(n) + 3.7e-9, digits) + 0.0).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def query(sql: str | None = None):
    """Registers a function of points as a query, rounded as its SQL is."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(points(spark, sf_dir)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table_query(sql: str | None = None):
    """Registers a function of a table reader as a query."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Point processes ---------------------------------------------------------------------------------

_N = "n AS (SELECT pattern_id, count(*) AS n FROM pts GROUP BY 1)"
_E = f"el AS (SELECT pattern_id, r, count(*) FILTER ({B} >= r) AS eligible, count(*) AS n FROM pts, rs GROUP BY 1, 2)"
_C = f"c AS (SELECT pattern_id, r, count(*) AS pairs FROM pr, rs WHERE d2 <= r * r AND r <= {BI} GROUP BY 1, 2)"


@query(f"""{BASE}, {_E}, {_C}, k AS (SELECT pattern_id, r, n, eligible, coalesce(pairs, 0) AS pairs,
    CASE WHEN eligible > 0 AND n > 1 THEN {AREA} * coalesce(pairs, 0) / (n * eligible) END AS k FROM el LEFT JOIN c USING (pattern_id, r))
    SELECT pattern_id, r, n, eligible, pairs, {q('k')} AS k, {q('sqrt(k / pi())')} AS l FROM k""")
def border_k(pts):
    return point_process.border_k(pts, RADII, WINDOW)


@query(f"""WITH {PTS}, {PR}, rs AS (SELECT unnest([15.0, 30.0, 40.0])::DOUBLE AS r),
    el AS (SELECT pattern_id, r, count(*) FILTER ({B} >= r + 10) AS eligible, count(*) AS n FROM pts, rs GROUP BY 1, 2),
    c AS (SELECT pattern_id, r, count(*) AS pairs, sum(0.75 * (1 - ((r - sqrt(d2)) / 10.0) * ((r - sqrt(d2)) / 10.0)) / 10.0) AS w FROM pr, rs
      WHERE abs(r - sqrt(d2)) < 10 AND r + 10 <= {BI} GROUP BY 1, 2)
    SELECT pattern_id, r, n, eligible, coalesce(pairs, 0) AS pairs,
      CASE WHEN eligible > 0 AND n > 1 THEN {q(f'{AREA} * coalesce(w, 0) / (2 * pi() * r * n * eligible)')} END AS g FROM el LEFT JOIN c USING (pattern_id, r)""")
def border_pair_correlation(pts):
    return point_process.border_g(pts, [15.0, 30.0, 40.0], 10.0, WINDOW)


_OV = "((1000.0 - abs(ix - jx)) * (1000.0 - abs(iy - jy)))"


@query(f"""{BASE}, {_N}, c AS (SELECT pattern_id, r, sum(2 * {AREA} / {_OV}) AS w FROM pr, rs WHERE i < j AND d2 <= r * r GROUP BY 1, 2),
    k AS (SELECT pattern_id, r, n, CASE WHEN n > 1 THEN {AREA} * coalesce(w, 0) / (n * (n - 1)) END AS k FROM n CROSS JOIN rs LEFT JOIN c USING (pattern_id, r))
    SELECT pattern_id, r, n, {q('k')} AS k, {q('sqrt(k / pi())')} AS l FROM k""")
def translation_k(pts):
    return point_process.translation_k(pts, RADII, WINDOW)


@query(f"""WITH {PTS}, {PR}, rs AS (SELECT unnest([15.0, 30.0, 40.0])::DOUBLE AS r), {_N},
    c AS (SELECT pattern_id, r, sum(2 * {AREA} / {_OV} * 0.75 * (1 - ((r - sqrt(d2)) / 10.0) * ((r - sqrt(d2)) / 10.0)) / 10.0) AS w FROM pr, rs WHERE i < j AND abs(r - sqrt(d2)) < 10 GROUP BY 1, 2)
    SELECT pattern_id, r, n, CASE WHEN n > 1 THEN {q(f'{AREA} * coalesce(w, 0) / (2 * pi() * r * n * (n - 1))')} END AS g FROM n CROSS JOIN rs LEFT JOIN c USING (pattern_id, r)""")
def translation_pair_correlation(pts):
    return point_process.translation_g(pts, [15.0, 30.0, 40.0], 10.0, WINDOW)


@query(f"""{BASE}, pb AS (SELECT pattern_id, k AS idx, (k % 10 + 0.5) * 100.0 AS x, (k // 10 + 0.5) * 100.0 AS y FROM (SELECT DISTINCT pattern_id FROM pts), range(100) t(k)),
    gn AS (SELECT pattern_id, i AS idx, min(d2) AS d2 FROM pr GROUP BY 1, 2),
    fn AS (SELECT b.pattern_id, b.idx, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM pb b JOIN pts a USING (pattern_id) GROUP BY 1, 2),
    g AS (SELECT pattern_id, r, count(*) FILTER (d2 <= r * r) / count(*)::DOUBLE AS g FROM pts LEFT JOIN gn USING (pattern_id, idx), rs WHERE {B} >= r GROUP BY 1, 2),
    f AS (SELECT pattern_id, r, count(*) FILTER (d2 <= r * r) / count(*)::DOUBLE AS f FROM pb LEFT JOIN fn USING (pattern_id, idx), rs WHERE {B} >= r GROUP BY 1, 2)
    SELECT pattern_id, r, {q('g')} AS g, {q('f')} AS f, CASE WHEN 1 - f > 1e-12 THEN {q('(1 - g) / (1 - f)')} END AS j
    FROM (SELECT DISTINCT pattern_id FROM pts) CROSS JOIN rs LEFT JOIN g USING (pattern_id, r) LEFT JOIN f USING (pattern_id, r)""")
def nearest_space(pts):
    return point_process.nearest_space(pts, RADII, 10, WINDOW)


@query(f"""{BASE}, t AS (SELECT pattern_id, count(*) AS targets FROM pts WHERE label = 'A' GROUP BY 1),
    el AS (SELECT pattern_id, r, count(*) FILTER ({B} >= r) AS eligible, count(*) AS sources FROM pts, rs WHERE label = 'R' GROUP BY 1, 2),
    c AS (SELECT pattern_id, r, count(*) AS pairs FROM pr, rs WHERE il = 'R' AND jl = 'A' AND d2 <= r * r AND r <= {BI} GROUP BY 1, 2)
    SELECT pattern_id, r, sources, targets, eligible, coalesce(pairs, 0) AS pairs, CASE WHEN eligible > 0 THEN {q(f'{AREA} * coalesce(pairs, 0) / (eligible * targets)')} END AS cross_k
    FROM el JOIN t USING (pattern_id) LEFT JOIN c USING (pattern_id, r)""")
def directed_cross_k(pts):
    return point_process.cross_k(pts, "R", "A", RADII, WINDOW)


_SH = "CASE WHEN d2 <= 225 THEN 15.0 WHEN d2 <= 900 THEN 30.0 ELSE 50.0 END::DOUBLE"


@query(f"""WITH {PTS}, {PR}, c AS (SELECT pattern_id, {_SH} AS r, il AS source, jl AS target, count(*) AS pairs FROM pr WHERE {_SH} <= {BI} GROUP BY 1, 2, 3, 4)
    SELECT pattern_id, r, source, target, pairs, (sum(pairs) OVER w)::BIGINT AS total, {q('pairs / sum(pairs) OVER w')} AS connection FROM c WINDOW w AS (PARTITION BY pattern_id, r)""")
def mark_connection(pts):
    return point_process.mark_connection(pts, RADII, WINDOW)


_M = "m AS (SELECT pattern_id, avg(value) AS mean, var_pop(value) AS variance, sum(value * value) AS sq, count(*) AS n FROM pts GROUP BY 1)"


@query(f"""{BASE}, {_M}, c AS (SELECT pattern_id, {_SH} AS r, avg(iv * jv) AS product, count(*) AS pairs FROM pr WHERE {_SH} <= {BI} GROUP BY 1, 2)
    SELECT pattern_id, r, coalesce(pairs, 0) AS pairs, CASE WHEN variance > 0 THEN {q('product / (mean * mean)')} END AS correlation FROM m CROSS JOIN rs LEFT JOIN c USING (pattern_id, r)""")
def continuous_mark_correlation(pts):
    return point_process.mark_correlation(pts, RADII, WINDOW)


@query(f"""{BASE}, {_E}, {_M}, c AS (SELECT pattern_id, r, sum(iv * jv) AS product FROM pr, rs WHERE d2 <= r * r AND r <= {BI} GROUP BY 1, 2)
    SELECT pattern_id, r, eligible, CASE WHEN eligible > 0 THEN {q(f'{AREA} * coalesce(product, 0) / (mean * mean) / (el.n * eligible)')} END AS weighted_k
    FROM el JOIN m USING (pattern_id) LEFT JOIN c USING (pattern_id, r)""")
def mark_weighted_k(pts):
    return point_process.mark_weighted_k(pts, RADII, WINDOW)


@query(f"""WITH {PTS}, {PR}, c AS (SELECT pattern_id, {_SH} AS r, count(*) AS pairs, avg(ipa * jpa) AS connection FROM pr GROUP BY 1, 2),
    s AS (SELECT pattern_id, count(*) AS n, sum(pa) AS s, sum(pa * pa) AS ss FROM pts GROUP BY 1)
    SELECT pattern_id, r, pairs, {q('connection')} AS connection, {q('(s * s - ss) / (n * (n - 1))')} AS expected FROM c JOIN s USING (pattern_id)""")
def probability_connection(pts):
    return point_process.probability_connection(pts, RADII, "pa")


@query(f"""WITH {PTS}, {PR}, b AS (SELECT * FROM (VALUES (0.0, 15.0, false), (15.0, 30.0, false), (30.0, 50.0, true)) t(lo, hi, closed)),
    c AS (SELECT pattern_id, lo, count(*) AS pairs, avg(0.5 * (iv - jv) * (iv - jv)) AS gamma FROM pr, b WHERE i < j AND d2 >= lo * lo AND (d2 < hi * hi OR closed AND d2 <= hi * hi) GROUP BY 1, 2)
    SELECT pattern_id, lo::DOUBLE AS lo, hi::DOUBLE AS hi, coalesce(pairs, 0) AS pairs, {q('gamma')} AS gamma FROM (SELECT DISTINCT pattern_id FROM pts) CROSS JOIN b LEFT JOIN c USING (pattern_id, lo)""")
def scalar_semivariogram(pts):
    return point_process.semivariogram(pts, [0.0, 15.0, 30.0, 50.0])


@query(f"""WITH {PTS}, {PR}, p AS (SELECT pattern_id, avg(mark) AS p FROM pts GROUP BY 1),
    c AS (SELECT pattern_id, floor(sqrt(d2) / 10)::INT AS bin, count(*) AS n, avg((im - p) * (jm - p)) AS cov FROM pr JOIN p USING (pattern_id) WHERE i < j AND d2 < 2500 GROUP BY 1, 2)
    SELECT pattern_id, bin::INT AS bin, bin * 10.0::DOUBLE AS r_min, coalesce(n, 0) AS pair_count, {q('cov')} AS covariance FROM p CROSS JOIN (SELECT unnest(range(5))::INT AS bin) LEFT JOIN c USING (pattern_id, bin)""")
def mark_pair_covariance(pts):
    return point_process.mark_pair_covariance(pts, 10.0, 50.0)


_Z = "e AS (SELECT pattern_id, count(*) AS edges, sum((iv - mean) * (jv - mean)) AS cross_, sum((iv - jv) * (iv - jv)) AS diff FROM pr JOIN m USING (pattern_id) GROUP BY 1)"


@query(f"""WITH {PTS}, {PR}, {_M}, {_Z} SELECT pattern_id, n, coalesce(edges, 0) AS edges, CASE WHEN edges > 0 AND variance > 0 THEN {q('n / edges::DOUBLE * cross_ / (variance * n)')} END AS moran_i FROM m LEFT JOIN e USING (pattern_id)""")
def global_moran(pts):
    return point_process.moran(pts, R)


@query(f"""WITH {PTS}, {PR}, {_M}, {_Z} SELECT pattern_id, n, coalesce(edges, 0) AS edges, CASE WHEN edges > 0 AND variance > 0 THEN {q('(n - 1) / (2.0 * edges) * diff / (variance * n)')} END AS geary_c FROM m LEFT JOIN e USING (pattern_id)""")
def global_geary(pts):
    return point_process.geary(pts, R)


@query(f"""WITH {PTS}, {PR}, {_M}, l AS (SELECT pattern_id, i AS idx, any_value(iv) AS v, avg(jv) AS near, count(*) AS neighbours FROM pr GROUP BY 1, 2),
    z AS (SELECT pattern_id, idx, neighbours, (v - mean) / sqrt(variance) AS z, (near - mean) / sqrt(variance) AS lag FROM l JOIN m USING (pattern_id) WHERE variance > 0)
    SELECT pattern_id, idx, neighbours, {q('z * lag')} AS local_i, CASE WHEN z >= 0 THEN 'high' ELSE 'low' END || '_' || CASE WHEN lag >= 0 THEN 'high' ELSE 'low' END AS quadrant FROM z""")
def local_moran(pts):
    return point_process.local_moran(pts, R)


@query(f"""WITH {PTS}, {PR}, {RS}, lam AS (SELECT pattern_id, idx, CASE WHEN x < 500 THEN count(*) OVER (PARTITION BY pattern_id, x < 500) ELSE count(*) OVER (PARTITION BY pattern_id, x < 500) END / 500000.0 AS lam FROM pts),
    low AS (SELECT pattern_id, r, sum(1 / lam) AS low FROM pts JOIN lam USING (pattern_id, idx), rs WHERE {B} >= r GROUP BY 1, 2),
    top AS (SELECT pr.pattern_id, r, sum(1 / (a.lam * b.lam)) AS top FROM pr JOIN lam a ON a.pattern_id = pr.pattern_id AND a.idx = pr.i JOIN lam b ON b.pattern_id = pr.pattern_id AND b.idx = pr.j, rs WHERE d2 <= r * r AND r <= {BI} GROUP BY 1, 2)
    SELECT pattern_id, r, {q('coalesce(top, 0) / low')} AS k FROM low LEFT JOIN top USING (pattern_id, r)""")
def piecewise_inhomogeneous_k(pts):
    from pyspark.sql.window import Window

    rich = pts.withColumn("side", F.col("x") < 500)
    return point_process.inhomogeneous_k(rich, F.count(F.lit(1)).over(Window.partitionBy("pattern_id", "side")) / 500000.0, RADII, WINDOW)


@query(f"""WITH {PTS}, {PR}, s AS (SELECT pattern_id, i AS idx, sum(exp(-d2 / 800.0)) AS s FROM pr GROUP BY 1, 2)
    SELECT pattern_id, idx, {q('coalesce(s, 0) / (pi() * 800.0)')} AS intensity FROM pts LEFT JOIN s USING (pattern_id, idx)""")
def gaussian_loo_intensity(pts):
    return point_process.loo_intensity(pts, 20.0, R)


@query(f"""WITH {PTS}, rnd AS (SELECT pattern_id, idx, (x * 7 + 13) % 1000 AS x, (y * 11 + 29) % 1000 AS y FROM pts), b AS (SELECT * FROM (VALUES (0, 0.0, 15.0), (1, 15.0, 30.0), (2, 30.0, 50.0)) t(bin, lo, hi)),
    dd AS (SELECT a.pattern_id, bin, count(*) AS dd FROM pts a JOIN pts b2 ON a.pattern_id = b2.pattern_id AND a.idx < b2.idx AND abs(a.x - b2.x) <= 50 AND abs(a.y - b2.y) <= 50, b WHERE (a.x-b2.x)*(a.x-b2.x)+(a.y-b2.y)*(a.y-b2.y) >= lo*lo AND (a.x-b2.x)*(a.x-b2.x)+(a.y-b2.y)*(a.y-b2.y) < hi*hi GROUP BY 1, 2),
    dr AS (SELECT a.pattern_id, bin, count(*) AS dr FROM pts a JOIN rnd b2 ON a.pattern_id = b2.pattern_id AND abs(a.x - b2.x) <= 50 AND abs(a.y - b2.y) <= 50, b WHERE (a.x-b2.x)*(a.x-b2.x)+(a.y-b2.y)*(a.y-b2.y) >= lo*lo AND (a.x-b2.x)*(a.x-b2.x)+(a.y-b2.y)*(a.y-b2.y) < hi*hi GROUP BY 1, 2),
    rr AS (SELECT a.pattern_id, bin, count(*) AS rr FROM rnd a JOIN rnd b2 ON a.pattern_id = b2.pattern_id AND a.idx < b2.idx AND abs(a.x - b2.x) <= 50 AND abs(a.y - b2.y) <= 50, b WHERE (a.x-b2.x)*(a.x-b2.x)+(a.y-b2.y)*(a.y-b2.y) >= lo*lo AND (a.x-b2.x)*(a.x-b2.x)+(a.y-b2.y)*(a.y-b2.y) < hi*hi GROUP BY 1, 2),
    n AS (SELECT pattern_id, count(*)::DOUBLE AS n FROM pts GROUP BY 1)
    SELECT pattern_id, bin::INT AS bin, coalesce(dd, 0) AS dd, coalesce(dr, 0) AS dr, coalesce(rr, 0) AS rr,
      CASE WHEN rr > 0 THEN {q('(coalesce(dd, 0) / (n * (n - 1) / 2) - 2 * coalesce(dr, 0) / (n * n) + rr / (n * (n - 1) / 2)) / (rr / (n * (n - 1) / 2))')} END AS xi
    FROM n CROSS JOIN (SELECT bin FROM b) LEFT JOIN dd USING (pattern_id, bin) LEFT JOIN dr USING (pattern_id, bin) LEFT JOIN rr USING (pattern_id, bin)""")
def landy_szalay(pts):
    own = pts.select("pattern_id", "idx", "x", "y")
    other = own.select("pattern_id", "idx", ((F.col("x") * 7 + 13) % 1000).alias("x"), ((F.col("y") * 11 + 29) % 1000).alias("y"))
    return point_process.landy_szalay(own, other, [0.0, 15.0, 30.0, 50.0])


_ALL = """al AS (SELECT a.pattern_id, a.idx AS i, b.idx AS j, a.x AS ix, a.y AS iy, b.x AS jx, b.y AS jy, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM pts a JOIN pts b ON a.pattern_id = b.pattern_id AND a.idx <> b.idx)"""


@query(f"""WITH {PTS}, {_ALL} SELECT pattern_id, {q('avg(sqrt(d2))')} AS mean_distance, count(*) AS points FROM (SELECT pattern_id, i, min(d2) AS d2 FROM al GROUP BY 1, 2) GROUP BY 1""")
def mean_nearest_distance(pts):
    return point_process.mean_nearest(pts, R)


# Neighbourhoods and graphs -----------------------------------------------------------------------


@query(f"""WITH {PTS}, {PR} SELECT pattern_id, i, j, {q('sqrt(d2)')} AS distance, {q('atan2(jy - iy, jx - ix)')} AS angle FROM pr WHERE i < j AND d2 <= 900""")
def radius_graph(pts):
    return neighbourhood.radius_edges(pts, 30.0).select("pattern_id", "i", "j", "distance", "angle")


@query(f"""WITH {PTS}, {_ALL} SELECT DISTINCT pattern_id, least(i, j) AS i, greatest(i, j) AS j, d2 FROM al QUALIFY row_number() OVER (PARTITION BY pattern_id, al.i ORDER BY d2, al.j) <= 3""")
def knn_graph(pts):
    return neighbourhood.knn_edges(pts, 3, R)


@query(f"""{BASE}, c AS (SELECT pattern_id, r, il AS a, jl AS b, count(*) AS pairs FROM pr, rs WHERE d2 <= r * r GROUP BY 1, 2, 3, 4),
    ro AS (SELECT pattern_id, r, a, sum(pairs) AS row_ FROM c GROUP BY 1, 2, 3), co AS (SELECT pattern_id, r, b, sum(pairs) AS col_ FROM c GROUP BY 1, 2, 3), t AS (SELECT pattern_id, r, sum(pairs) AS total FROM c GROUP BY 1, 2),
    s AS (SELECT DISTINCT pattern_id, label FROM pts)
    SELECT pattern_id, r, a, b, coalesce(pairs, 0) AS pairs, CASE WHEN row_ > 0 AND col_ > 0 THEN {q('coalesce(pairs, 0) * total / (row_ * col_)::DOUBLE')} END AS score
    FROM (SELECT s.pattern_id, s.label AS a, s2.label AS b FROM s JOIN s s2 USING (pattern_id)) JOIN t USING (pattern_id) LEFT JOIN ro USING (pattern_id, r, a) LEFT JOIN co USING (pattern_id, r, b) LEFT JOIN c USING (pattern_id, r, a, b)""")
def categorical_cooccurrence(pts):
    return neighbourhood.cooccurrence(pts, RADII)


@query(f"""WITH {PTS}, {PR}, n AS (SELECT pattern_id, count(*)::DOUBLE AS n FROM pts GROUP BY 1), k AS (SELECT pattern_id, label, count(*)::DOUBLE AS k FROM pts GROUP BY 1, 2),
    c AS (SELECT pattern_id, least(il, jl) AS a, greatest(il, jl) AS b, count(*) AS edges FROM pr WHERE i < j GROUP BY 1, 2, 3),
    g AS (SELECT pattern_id, sum(d) / 2.0 AS e, sum(d * (d - 1)) / 2.0 AS adj FROM (SELECT pattern_id, i, count(*) AS d FROM pr GROUP BY 1, 2) GROUP BY 1),
    p AS (SELECT ka.pattern_id, ka.label AS a, kb.label AS b, e, adj, e * (e - 1) / 2 - adj AS dis,
      CASE WHEN ka.label = kb.label THEN ka.k * (ka.k - 1) / (n * (n - 1)) ELSE 2 * ka.k * kb.k / (n * (n - 1)) END AS p1,
      CASE WHEN ka.label = kb.label THEN ka.k * (ka.k - 1) * (ka.k - 2) ELSE ka.k * kb.k * (kb.k - 1) + kb.k * ka.k * (ka.k - 1) END / (n * (n - 1) * (n - 2)) AS p2,
      CASE WHEN ka.label = kb.label THEN ka.k * (ka.k - 1) * (ka.k - 2) * (ka.k - 3) ELSE 4 * ka.k * (ka.k - 1) * kb.k * (kb.k - 1) END / (n * (n - 1) * (n - 2) * (n - 3)) AS p3
      FROM k ka JOIN k kb ON ka.pattern_id = kb.pattern_id AND ka.label <= kb.label JOIN n ON n.pattern_id = ka.pattern_id JOIN g ON g.pattern_id = ka.pattern_id),
    v AS (SELECT *, e * p1 AS mean, e * p1 + 2 * adj * p2 + 2 * dis * p3 - e * p1 * e * p1 AS variance FROM p)
    SELECT pattern_id, a, b, coalesce(edges, 0) AS edges, {q('mean', 4)} AS mean, {q('variance', 4)} AS variance, CASE WHEN variance > 1e-9 THEN {q('(coalesce(edges, 0) - mean) / sqrt(variance)', 4)} END AS z FROM v LEFT JOIN c USING (pattern_id, a, b)""")
def categorical_enrichment(pts):
    return rounded(neighbourhood.enrichment(pts, R), 4)


@query(f"""WITH {PTS}, {PR}, c AS (SELECT pattern_id, il AS a, jl AS b, count(*) AS pairs FROM pr GROUP BY 1, 2, 3), k AS (SELECT pattern_id, label, count(*) AS k FROM pts GROUP BY 1, 2), {_N},
    s AS (SELECT *, pairs / sum(pairs) OVER (PARTITION BY pattern_id, a) AS share, pairs / sum(pairs) OVER (PARTITION BY pattern_id) AS fraction FROM c),
    h AS (SELECT pattern_id, a, -sum(share * ln(share)) AS row_entropy FROM s GROUP BY 1, 2)
    SELECT pattern_id, a, b, pairs, {q('fraction')} AS fraction, {q('ka.k * (kb.k - CASE WHEN a = b THEN 1 ELSE 0 END) / (n * (n - 1))::DOUBLE')} AS expected, {q('row_entropy')} AS row_entropy
    FROM s JOIN h USING (pattern_id, a) JOIN n USING (pattern_id) JOIN k ka ON ka.pattern_id = s.pattern_id AND ka.label = a JOIN k kb ON kb.pattern_id = s.pattern_id AND kb.label = b""")
def neighbourhood_mixing(pts):
    return neighbourhood.neighbourhood_mixing(pts, R)


@query(f"""{BASE}, k AS (SELECT pattern_id, i AS idx, r, jl AS b, count(*) AS k FROM pr, rs WHERE d2 <= r * r GROUP BY 1, 2, 3, 4),
    n AS (SELECT pattern_id, idx, r, sum(k)::BIGINT AS neighbours, sum(k * ln(k)) AS klk, arg_max(b, k * 1000 - ascii(b)) AS top, max(k) AS most FROM k GROUP BY 1, 2, 3 HAVING sum(k) >= 3)
    SELECT pattern_id, idx, r, neighbours, {q('exp(ln(neighbours) - klk / neighbours)')} AS effective, CASE WHEN most >= 0.5 * neighbours THEN top END AS dominant FROM n""")
def neighbourhood_map(pts):
    return neighbourhood.neighbourhood_map(pts, RADII, 3, 0.5)


_H = "(CASE WHEN a > 0 THEN -a * ln(a) ELSE 0 END + CASE WHEN b > 0 THEN -b * ln(b) ELSE 0 END + CASE WHEN c > 0 THEN -c * ln(c) ELSE 0 END)"


@query(f"""WITH {PTS}, s AS (SELECT pattern_id, avg(pa) AS a, avg(pb) AS b, avg(pc) AS c FROM pts GROUP BY 1)
    SELECT pattern_id, {q('a')} AS pa, {q('b')} AS pb, {q('c')} AS pc, {q(_H)} AS entropy, {q(f'exp({_H})')} AS effective FROM s""")
def soft_class_composition(pts):
    return neighbourhood.soft_composition(pts, ["pa", "pb", "pc"])


@query(f"""WITH {PTS}, {PR} SELECT pattern_id, i AS idx, count(*) AS neighbours, {q('avg(jpa)')} AS pa, {q('avg(jpb)')} AS pb, {q('avg(jpc)')} AS pc FROM pr GROUP BY 1, 2""")
def soft_neighbourhood_composition(pts):
    return neighbourhood.soft_neighbourhood(pts, R, ["pa", "pb", "pc"])


@query(f"""WITH {PTS}, {PR}, n AS (SELECT pattern_id, count(*) AS visits FROM pr GROUP BY 1), m AS (SELECT pattern_id, count(*) AS n FROM pts GROUP BY 1),
    l AS (SELECT pattern_id, i, j, unnest([ipa, ipb, ipc]) AS p, unnest(['pa', 'pb', 'pc']) AS a FROM pr), s AS (SELECT pattern_id, i, j, unnest([jpa, jpb, jpc]) AS p, unnest(['pa', 'pb', 'pc']) AS b FROM pr),
    o AS (SELECT l.pattern_id, a, b, avg(l.p * s.p) AS mass FROM l JOIN s ON l.pattern_id = s.pattern_id AND l.i = s.i AND l.j = s.j GROUP BY 1, 2, 3),
    u AS (SELECT pattern_id, idx, unnest([pa, pb, pc]) AS p, unnest(['pa', 'pb', 'pc']) AS a FROM pts), t AS (SELECT pattern_id, a, sum(p) AS s FROM u GROUP BY 1, 2),
    x AS (SELECT u1.pattern_id, u1.a AS a, u2.a AS b, sum(u1.p * u2.p) AS x FROM u u1 JOIN u u2 ON u1.pattern_id = u2.pattern_id AND u1.idx = u2.idx GROUP BY 1, 2, 3)
    SELECT o.pattern_id, visits, o.a, o.b, {q('mass')} AS mass, {q('(ta.s * tb.s - x) / (n * (n - 1))')} AS expected FROM o JOIN n USING (pattern_id) JOIN m USING (pattern_id)
    JOIN t ta ON ta.pattern_id = o.pattern_id AND ta.a = o.a JOIN t tb ON tb.pattern_id = o.pattern_id AND tb.a = o.b JOIN x ON x.pattern_id = o.pattern_id AND x.a = o.a AND x.b = o.b""")
def soft_pair_mixing(pts):
    return neighbourhood.soft_pair_mixing(pts, R, ["pa", "pb", "pc"])


@query(f"""WITH {PTS}, k AS (SELECT pattern_id, value AS level, count(*) AS k FROM pts GROUP BY 1, 2)
    SELECT pattern_id, {q('level')} AS level, k, {q('k / sum(k) OVER (PARTITION BY pattern_id)')} AS fraction, {q('sum(k) OVER (PARTITION BY pattern_id ORDER BY level ROWS UNBOUNDED PRECEDING) / sum(k) OVER (PARTITION BY pattern_id)')} AS cumulative FROM k""")
def ordinal_composition(pts):
    return neighbourhood.ordinal_composition(pts, "value")


@query(f"""WITH {PTS}, {PR}, e AS (SELECT pattern_id, count(*) AS edges, sum((ipa - jpa) * (ipa - jpa) + (ipb - jpb) * (ipb - jpb)) AS energy FROM pr WHERE i < j GROUP BY 1),
    s AS (SELECT pattern_id, (var_pop(pa) + var_pop(pb)) * count(*) AS spread FROM pts GROUP BY 1)
    SELECT pattern_id, edges, {q('energy')} AS energy, CASE WHEN spread > 0 THEN {q('energy / spread')} END AS normalised FROM e JOIN s USING (pattern_id)""")
def dirichlet_energy(pts):
    return neighbourhood.dirichlet_energy(pts, R, ["pa", "pb"])


@query(f"""WITH {PTS}, {PR}, e AS (SELECT pattern_id, i AS idx, count(*) AS degree, sum((iv - jv) * (iv - jv)) AS rough FROM pr GROUP BY 1, 2)
    SELECT pattern_id, idx, coalesce(degree, 0) AS degree, {q('rough / degree')} AS roughness FROM pts LEFT JOIN e USING (pattern_id, idx)""")
def local_roughness(pts):
    return neighbourhood.local_roughness(pts, R)


@query(f"""WITH {PTS}, {PR} SELECT pattern_id, idx, {q('(value + coalesce(s, 0)) / (1 + coalesce(n, 0))')} AS smoothed FROM pts LEFT JOIN (SELECT pattern_id, i AS idx, sum(jv) AS s, count(*) AS n FROM pr GROUP BY 1, 2) USING (pattern_id, idx)""")
def graph_smoothing(pts):
    return neighbourhood.graph_smoothing(pts, R)


_TRI = "t AS (SELECT a.pattern_id, a.i, a.j, b.j AS k, a.il, a.jl, b.jl AS kl FROM pr a JOIN pr b ON a.pattern_id = b.pattern_id AND a.j = b.i JOIN pr c ON c.pattern_id = a.pattern_id AND c.i = a.i AND c.j = b.j WHERE a.i < a.j AND b.i < b.j)"


@query(f"""WITH {PTS}, {PR}, {_TRI} SELECT pattern_id, array_to_string(list_sort([il, jl, kl]), '-') AS motif, count(*) AS triangles FROM t GROUP BY 1, 2""")
def triangle_motifs(pts):
    return neighbourhood.triangles(pts, R)


@query(f"""WITH {PTS}, {PR}, {_TRI}, d AS (SELECT pattern_id, i AS idx, count(*) AS degree FROM pr GROUP BY 1, 2 HAVING count(*) > 1),
    u AS (SELECT pattern_id, unnest([i, j, k]) AS idx FROM t), c AS (SELECT pattern_id, idx, count(*) AS t FROM u GROUP BY 1, 2)
    SELECT pattern_id, idx, degree, {q('2 * coalesce(t, 0) / (degree * (degree - 1))::DOUBLE')} AS clustering FROM d LEFT JOIN c USING (pattern_id, idx)""")
def clustering_coefficient(pts):
    return neighbourhood.clustering(pts, R)


@query(f"""WITH {PTS}, {_ALL}, k AS (SELECT pattern_id, i, 6 * atan2(jy - iy, jx - ix) AS a FROM al QUALIFY row_number() OVER (PARTITION BY pattern_id, i ORDER BY d2, j) <= 6)
    SELECT pattern_id, i AS idx, count(*) AS neighbours, {q('sqrt(avg(cos(a)) * avg(cos(a)) + avg(sin(a)) * avg(sin(a)))')} AS "order" FROM k GROUP BY 1, 2""")
def bond_orientational_order(pts):
    return neighbourhood.bond_order(pts, 6, R)


@query(f"""WITH RECURSIVE {PTS}, {PR}, nr AS MATERIALIZED (SELECT pattern_id, i, j FROM pr WHERE d2 <= 900), co AS MATERIALIZED (SELECT pattern_id, i FROM nr GROUP BY 1, 2 HAVING count(*) >= 4),
    li AS MATERIALIZED (SELECT n.* FROM nr n JOIN co a ON a.pattern_id = n.pattern_id AND a.i = n.i JOIN co b ON b.pattern_id = n.pattern_id AND b.i = n.j),
    la(pattern_id, i, c) USING KEY (pattern_id, i) AS (SELECT pattern_id, i, i FROM co UNION SELECT l.pattern_id, l.i, min(w.c) FROM li l JOIN la w ON w.pattern_id = l.pattern_id AND w.i = l.j JOIN recurring.la o ON o.pattern_id = l.pattern_id AND o.i = l.i WHERE w.c < o.c GROUP BY 1, 2)
    SELECT pattern_id, i AS idx, c AS cluster, true AS core FROM la UNION ALL SELECT n.pattern_id, n.i, min(l.c), false FROM nr n JOIN la l ON l.pattern_id = n.pattern_id AND l.i = n.j ANTI JOIN co ON co.pattern_id = n.pattern_id AND co.i = n.i GROUP BY 1, 2""")
def density_clusters(pts):
    return neighbourhood.density_clusters(pts, 30.0, 5)


def _xl(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN ({a}) * ln(({a}) / ({b})) ELSE 0 END"


@query(f"""WITH {PTS}, {PR}, d AS (SELECT pattern_id, idx AS i, 1.0 + coalesce(c, 0) AS ni, mark + coalesce(m, 0.0) AS mi FROM pts LEFT JOIN (SELECT pattern_id, i AS idx, count(*) AS c, sum(jm) AS m FROM pr GROUP BY 1, 2) USING (pattern_id, idx)),
    t AS (SELECT pattern_id, count(*)::DOUBLE AS n, sum(mark)::DOUBLE AS m FROM pts GROUP BY 1),
    s AS (SELECT pattern_id, i, ni::DOUBLE AS ni, mi::DOUBLE AS mi, n, m FROM d JOIN t USING (pattern_id) WHERE ni >= 2 AND ni <= n / 2 AND n - ni >= 2),
    l AS (SELECT *, round(CASE WHEN mi * (n - ni) > (m - mi) * ni THEN {_xl('mi', 'ni')} + {_xl('ni - mi', 'ni')} + {_xl('m - mi', 'n - ni')} + {_xl('(n - ni) - (m - mi)', 'n - ni')} - {_xl('m', 'n')} - {_xl('n - m', 'n')} ELSE 0 END, 9) AS llr FROM s)
    SELECT pattern_id, i AS centre, {q('llr')} AS llr, ni::BIGINT AS inside, mi::BIGINT AS marked FROM l QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY llr DESC, i) = 1""")
def bernoulli_scan(pts):
    return neighbourhood.disc_scan(pts, R)


@query(f"""WITH {PTS}, {PR} SELECT pattern_id, (sum(k) / 2)::BIGINT AS close_pairs, sum(least(k, 4))::BIGINT AS saturated FROM (SELECT pattern_id, i, count(*) AS k FROM pr WHERE d2 <= 900 GROUP BY 1, 2) GROUP BY 1""")
def close_pair_statistics(pts):
    return neighbourhood.close_pairs(pts, 30.0, 4)


# Tables ------------------------------------------------------------------------------------------


@query(f"""WITH {PTS} SELECT pattern_id, count(*) AS n, {q('avg((x < 500)::INT)')} AS west, {q('avg((value > 25)::INT)')} AS large FROM pts WHERE stratum = 'F' AND label <> 'N' GROUP BY 1""")
def admission_and_flags(pts):
    flagged = pts.withColumns({"west": F.col("x") < 500, "large": F.col("value") > 25, "good": F.col("stratum") == "F", "bad": F.col("label") == "N"})
    return tables.flag_fractions(tables.admitted(flagged, F.col("x") >= 0, ["good"], ["bad"]), ["west", "large"], "pattern_id")


@query(f"""WITH {PTS} SELECT pattern_id, stratum, count(*) AS n, sum(mark)::BIGINT AS marked, {q('avg(mark)')} AS prevalence, {q('avg(value)')} AS mean, {q('var_pop(value)')} AS variance, {q('var_samp(value)')} AS sample_variance, {q('quantile_cont(value, 0.5)')} AS median FROM pts GROUP BY 1, 2""")
def mark_summary(pts):
    return tables.mark_summary(pts, "pattern_id", "stratum")


@query(f"""WITH {PTS} SELECT pattern_id, {q('value')} AS percentile FROM (SELECT pattern_id, value, row_number() OVER (PARTITION BY pattern_id ORDER BY value) AS k, count(*) OVER (PARTITION BY pattern_id) AS n FROM pts) WHERE k = ceil(0.9 * n)""")
def nearest_rank_percentile(pts):
    return tables.nearest_rank(pts, 0.9, "value", "pattern_id")


@query(f"""WITH {PTS}, s AS (SELECT pattern_id, count(*) AS n, sum(mark) AS m FROM pts GROUP BY 1)
    SELECT pattern_id, n, concat_ws(',', CASE WHEN n < 600 THEN 'too_few_cells' END, CASE WHEN m < 190 THEN 'too_few_marked' END, CASE WHEN n - m < 25 THEN 'too_few_unmarked' END, CASE WHEN m / n < 0.3 OR m / n > 0.98 THEN 'prevalence_out_of_range' END) AS flags FROM s""")
def validation_flags(pts):
    return tables.validation_flags(pts, 600, 190, 25, 0.3, 0.98, "pattern_id")


def _mo(w: int) -> str:
    return f"SELECT pattern_id, {w}.0::DOUBLE AS width, {q(f'{(1000 // w) ** 2}.0 * sum(k * (k - 1)) / (sum(k) * (sum(k) - 1))')} AS morisita FROM (SELECT pattern_id, count(*) AS k FROM pts GROUP BY 1, floor(x / {w}), floor(y / {w})) GROUP BY 1 HAVING sum(k) > 1"


@query(f"WITH {PTS} {_mo(50)} UNION ALL {_mo(100)} UNION ALL {_mo(200)}")
def morisita(pts):
    return tables.morisita(pts, [50.0, 100.0, 200.0], 1000.0, "pattern_id")


def _bx(w: int) -> str:
    return f"SELECT pattern_id, ln({w}.0) AS w, count(*) AS boxes FROM (SELECT DISTINCT pattern_id, floor(x / {w}), floor(y / {w}) FROM pts) GROUP BY 1"


@query(f"WITH {PTS}, b AS ({_bx(50)} UNION ALL {_bx(100)} UNION ALL {_bx(200)}) SELECT pattern_id, {q('-regr_slope(ln(boxes), w)')} AS dimension, max(boxes) AS finest_boxes FROM b GROUP BY 1")
def box_dimension(pts):
    return tables.box_dimension(pts, [50.0, 100.0, 200.0], "pattern_id")


@query(f"""WITH {PTS}, g AS (SELECT p.pattern_id, gx, gy, coalesce(v, 0.0)::DOUBLE AS v FROM (SELECT DISTINCT pattern_id FROM pts) p CROSS JOIN (SELECT unnest(range(20)) AS gx) CROSS JOIN (SELECT unnest(range(20)) AS gy)
      LEFT JOIN (SELECT pattern_id, floor(x / 50)::BIGINT AS gx, floor(y / 50)::BIGINT AS gy, sum(mark) AS v FROM pts GROUP BY 1, 2, 3) USING (pattern_id, gx, gy)),
    d AS (SELECT *, lead(v) OVER (PARTITION BY pattern_id, gy ORDER BY gx) AS r, lead(v) OVER (PARTITION BY pattern_id, gx ORDER BY gy) AS dn FROM g),
    t AS (SELECT pattern_id, var_pop(v) AS total, (sum((v - r) * (v - r)) + sum((v - dn) * (v - dn))) / (count(r) + count(dn)) AS e FROM d GROUP BY 1),
    b AS (SELECT pattern_id, var_pop(m) AS blocks FROM (SELECT pattern_id, avg(v) AS m FROM g GROUP BY 1, gx // 2, gy // 2) GROUP BY 1)
    SELECT pattern_id, {q('total')} AS total, {q('e')} AS difference_energy, CASE WHEN total > 0 THEN {q('blocks / total')} END AS block_share FROM t JOIN b USING (pattern_id)""")
def scale_energies(pts):
    return tables.scale_energies(pts, 50.0, 20, "pattern_id")


@query(f"""WITH {PTS}, c AS (SELECT l_suppkey::BIGINT AS pattern_id, l_linenumber, count(*) AS k FROM lineitem GROUP BY 1, 2)
    SELECT pattern_id, count(*) AS components, {q('max(k) / sum(k)')} AS largest_share, CASE WHEN max(k) / sum(k) < 0.8 THEN 'both' ELSE 'pooled' END AS mode FROM c GROUP BY 1""")
def component_summary(pts):
    return tables.component_summary(pts, "component", "pattern_id")


_ENS = {"label": 1, "stratum": 1, "mark": 1, "label+stratum": 2, "label+mark": 2, "stratum+mark": 2, "label+stratum+mark": 3}


@query(f"WITH {PTS}, h AS (" + " UNION ALL ".join(f"SELECT pattern_id, '{e}' AS ensemble, {s} AS size, ln(sum(k)) / ln(2) - sum(k * ln(k)) / sum(k) / ln(2) AS h FROM (SELECT pattern_id, {e.replace('+', ', ')}, count(*) AS k FROM pts GROUP BY ALL) GROUP BY 1" for e, s in _ENS.items()) + f") SELECT pattern_id, ensemble, size, {q('h')} AS entropy, {q('sum(CASE WHEN size % 2 = 1 THEN h ELSE -h END) OVER (PARTITION BY pattern_id)')} AS co_information FROM h")
def ensemble_information(pts):
    return tables.joint_information(pts, ["label", "stratum", "mark"], "pattern_id")


@query(f"""WITH {PTS}, w AS (SELECT pattern_id, label AS t, stratum AS a, x < 500 AS b FROM pts), n AS (SELECT pattern_id, count(*) AS n FROM w GROUP BY 1), kt AS (SELECT pattern_id, t, count(*) AS kt FROM w GROUP BY 1, 2),
    {', '.join(f"i{k} AS (SELECT pattern_id, t, sum(k / kt * log2(k / ks / (kt / n))) AS i{k} FROM (SELECT pattern_id, t, {c}, count(*) AS k, sum(count(*)) OVER (PARTITION BY pattern_id, {c}) AS ks FROM w GROUP BY pattern_id, t, {c}) JOIN kt USING (pattern_id, t) JOIN n USING (pattern_id) GROUP BY 1, 2)" for k, c in enumerate(("a", "b", "a, b"), 1))},
    s AS (SELECT pattern_id, sum(kt / n * least(i1, i2)) AS shared, sum(kt / n * i1) AS m1, sum(kt / n * i2) AS m2, sum(kt / n * i3) AS m12 FROM kt JOIN n USING (pattern_id) JOIN i1 USING (pattern_id, t) JOIN i2 USING (pattern_id, t) JOIN i3 USING (pattern_id, t) GROUP BY 1)
    SELECT pattern_id, {q('shared')} AS shared, {q('m1 - shared')} AS unique_first, {q('m2 - shared')} AS unique_second, {q('m12 - m1 - m2 + shared')} AS synergy FROM s""")
def information_decomposition(pts):
    return tables.redundancy(pts.withColumn("west", F.col("x") < 500), "label", "stratum", "west", "pattern_id")


@query(f"""WITH {PTS}, k AS (SELECT pattern_id, label, count(*) AS k FROM pts GROUP BY 1, 2), u AS (SELECT pattern_id, sum(k) AS n, ln(sum(k)) - sum(k * ln(k)) / sum(k) AS h FROM k GROUP BY 1),
    p AS (SELECT ln(sum(k)) - sum(k * ln(k)) / sum(k) AS gamma FROM (SELECT label, sum(k) AS k FROM k GROUP BY 1))
    SELECT {q('a')} AS alpha, {q('gamma')} AS gamma, {q('gamma - a')} AS beta FROM (SELECT sum(n * h) / sum(n) AS a FROM u), p""")
def class_diversity(pts):
    return tables.diversity(pts, "label", "pattern_id")


@query(f"WITH {PTS} SELECT pattern_id, stratum, count(*) AS n, {q('(sum(mark) + 1) / (count(*) + 2.0)')} AS mean, {q('(sum(mark) + 1) * (count(*) - sum(mark) + 1) / ((count(*) + 2.0) * (count(*) + 2.0) * (count(*) + 3.0))')} AS variance FROM pts GROUP BY 1, 2")
def beta_posterior(pts):
    return models.beta_posterior(pts, 1.0, 1.0, "pattern_id", "stratum")


_MODES = "md AS (SELECT a.v AS mx, b.v AS my, 2 * pi() / 1000 * a.v AS kx, 2 * pi() / 1000 * b.v AS ky, 2 * pi() / 1000 * sqrt(a.v * a.v + b.v * b.v) AS k FROM (SELECT unnest(range(0, 9)) AS v) a, (SELECT unnest(range(-8, 9)) AS v) b WHERE (a.v > 0 OR b.v > 0) AND 2 * pi() / 1000 * sqrt(a.v * a.v + b.v * b.v) BETWEEN 0.006 AND 0.045)"
_SF = f"""{_N}, p AS (SELECT pattern_id, avg(mark) AS p FROM pts GROUP BY 1),
  sf AS (SELECT pattern_id, mx, my, k, (pow(sum((mark - p) * cos(kx * x + ky * y)), 2) + pow(sum((mark - p) * sin(kx * x + ky * y)), 2)) / any_value(n) AS power FROM pts JOIN p USING (pattern_id) JOIN n USING (pattern_id), md GROUP BY 1, 2, 3, 4)"""


def _powers(pts):
    return models.structure_factor(pts, models.wave_numbers(pts.sparkSession, 1000.0, 0.006, 0.045))


@query(f"WITH {PTS}, {_MODES}, {_SF} SELECT pattern_id, mx::INT AS mx, my::INT AS my, {q('k')} AS k, {q('power')} AS power FROM sf")
def structure_factor(pts):
    return _powers(pts)


@query(f"WITH {PTS}, {_MODES}, {_SF} SELECT pattern_id, least(floor((k - 0.006) / (0.039 / 6)), 5)::INT AS shell, count(*) AS modes, {q('avg(power)')} AS power FROM sf GROUP BY 1, 2")
def shell_power(pts):
    return models.shell_means(_powers(pts), 0.006, 0.045, 6)


@query(f"""WITH {PTS}, {_MODES}, {_SF}, t AS (SELECT pattern_id, sum(power * mx * mx) AS xx, sum(power * mx * my) AS xy, sum(power * my * my) AS yy FROM sf GROUP BY 1),
    e AS (SELECT *, (xx + yy) / 2 AS h, sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) AS r FROM t) SELECT pattern_id, {q('(h + r) / nullif(h - r, 0)')} AS ratio, {q('0.5 * atan2(2 * xy, xx - yy)')} AS axis FROM e""")
def anisotropy(pts):
    return models.anisotropy(_powers(pts), 1000.0)


# Cohorts, embeddings, series ---------------------------------------------------------------------

_PAT = "p AS (SELECT c_custkey::BIGINT AS patient, c_mktsegment AS grp, n_regionkey::INT AS site, c_acctbal::DOUBLE AS value FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _patients(t):
    return t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("long").alias("patient"), F.col("c_mktsegment").alias("grp"), F.col("n_regionkey").cast("int").alias("site"), F.col("c_acctbal").cast("double").alias("value"))


_WE = """w AS (SELECT site, count(*) FILTER (grp = 'BUILDING') AS n0, count(*) FILTER (grp = 'MACHINERY') AS n1, avg(value) FILTER (grp = 'BUILDING') AS m0, avg(value) FILTER (grp = 'MACHINERY') AS m1,
  var_samp(value) FILTER (grp = 'BUILDING') AS v0, var_samp(value) FILTER (grp = 'MACHINERY') AS v1 FROM p GROUP BY 1)"""


@table_query(f"""WITH {_PAT}, {_WE} SELECT site, n0 AS n_first, n1 AS n_second, {q('m0 - m1')} AS difference, {q('sqrt(v0 / n0 + v1 / n1)')} AS standard_error, {q('(m0 - m1) / sqrt(v0 / n0 + v1 / n1)')} AS t FROM w""")
def welch_contrast(t):
    return cohort.welch(_patients(t), "BUILDING", "MACHINERY", "site")


@table_query(f"""WITH {_PAT}, {_WE}, s AS (SELECT m0 - m1 AS x, 1 / (v0 / n0 + v1 / n1) AS w FROM w WHERE n0 > 1 AND n1 > 1), a AS (SELECT count(*) AS k, sum(w) AS w, sum(w * w) AS ww, sum(w * x) AS wx, sum(w * x * x) AS wxx FROM s)
    SELECT k AS sites, {q('wx / w')} AS pooled, {q('sqrt(1 / w)')} AS standard_error, {q('wxx - wx * wx / w')} AS q, {q('greatest(0, (wxx - wx * wx / w - (k - 1)) / (w - ww / w))', 3)} AS tau2 FROM a""")
def multisite_pooling(t):
    out = cohort.multisite(cohort.welch(_patients(t), "BUILDING", "MACHINERY", "site").where("standard_error is not null"), "difference")
    return out.withColumn("tau2", F.round("tau2", 3))


_TAIL = "(SELECT sum(w * pow(greatest(cos({0} + (pi() / 2 - {0}) * k / 4000.0), 0), n - 2)) * (pi() / 2 - {0}) FROM sk) / (SELECT sum(w * pow(greatest(cos(pi() * (k / 4000.0 - 0.5)), 0), n - 2)) * pi() FROM sk)"


@table_query(f"""WITH {_PAT}, sk AS (SELECT k, CASE WHEN k IN (0, 4000) THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END AS w FROM (SELECT unnest(range(4001)) AS k)), s AS (SELECT grp, count(*) AS n, avg((value - 4500) / 1000) AS mean, stddev_samp((value - 4500) / 1000) / sqrt(count(*)) AS se FROM p GROUP BY 1),
    t AS (SELECT *, (mean + 0.5) / se AS t_low, (0.5 - mean) / se AS t_high FROM s), a AS (SELECT *, atan(t_low / sqrt(n - 1)) AS al, atan(t_high / sqrt(n - 1)) AS ah FROM t), b AS (SELECT *, {_TAIL.format('al')} AS p_low, {_TAIL.format('ah')} AS p_high FROM a)
    SELECT grp, n, {q('mean')} AS mean, {q('se')} AS se, {q('t_low')} AS t_low, {q('t_high')} AS t_high, {q('p_low')} AS p_low, {q('p_high')} AS p_high, greatest(p_low, p_high) < 0.05 AS equivalent FROM b""")
def equivalence_test(t):
    return cohort.equivalence(_patients(t).withColumn("effect", (F.col("value") - 4500) / 1000), 0.5, 0.05, "grp")


@table_query(f"WITH {_PAT}, a AS (SELECT site, grp, avg(value) AS v FROM p GROUP BY 1, 2) SELECT site, {q('avg(v)')} AS value FROM a GROUP BY 1")
def nested_means(t):
    return cohort.nested_mean(_patients(t).select("site", "grp", "value"), ["site", "grp"])


_NULL = f"""{_PAT}, o AS (SELECT site, patient, grp = 'BUILDING' AS g, value FROM p), {shuffle('sg', 'o', 'site', 'patient', 'g', 199, 20240)},
    ev AS (SELECT site, 0 AS replicate, g, value FROM o UNION ALL SELECT site, replicate, sg.g, value FROM sg JOIN (SELECT site, patient, value FROM o) USING (site, patient)),
    nl AS (SELECT site, replicate, (avg(value) FILTER (g) - avg(value) FILTER (NOT g)) / sqrt(var_samp(value) FILTER (g) / count(*) FILTER (g) + var_samp(value) FILTER (NOT g) / count(*) FILTER (NOT g)) AS t FROM ev GROUP BY 1, 2),
    ob AS (SELECT site, abs(t) AS s FROM nl WHERE replicate = 0)"""


def _null(t):
    return cohort.permutation_contrasts(_patients(t).select("site", "patient", (F.col("grp") == "BUILDING").alias("is_first"), "value"), 199, 20240, "site", id_col="patient")


@table_query(f"""WITH {_NULL}, mx AS (SELECT replicate, max(abs(t)) AS m FROM nl WHERE replicate > 0 GROUP BY 1) SELECT site, {q('s')} AS statistic, {q('(1 + count(*) FILTER (m >= s)) / (1.0 + count(*))')} AS p_adjusted FROM ob, mx GROUP BY site, s""")
def max_t_adjusted(t):
    return cohort.max_t(_null(t), "site")


@table_query(f"""WITH {_NULL}, pv AS (SELECT site, (1 + count(*) FILTER (abs(t) >= s)) / (1.0 + count(*)) AS p FROM nl JOIN ob USING (site) WHERE replicate > 0 GROUP BY 1), rw AS (SELECT site, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, site) AS raw FROM pv)
    SELECT site, {q('p')} AS p, {q('least(1.0, min(raw) OVER (ORDER BY p DESC, site DESC ROWS UNBOUNDED PRECEDING))')} AS q FROM rw""")
def permutation_p_values(t):
    null = _null(t)
    seen = null.where("replicate = 0").select("site", F.col("statistic").alias("s"))
    reached = F.sum((F.abs("statistic") >= F.abs("s")).cast("int"))
    p = null.where("replicate > 0").join(F.broadcast(seen), "site").groupBy("site").agg(plus_one_p(reached, F.count(F.lit(1))).alias("p"))
    return benjamini_hochberg(p.withColumn("family", F.lit(1)), "p", "site", "family").drop("family")


@table_query("""WITH s AS (SELECT o_custkey % 20 AS replicate, quarter(o_orderdate)::INT AS bin, count(*)::DOUBLE AS value FROM orders GROUP BY 1, 2), n AS (SELECT count(DISTINCT replicate) AS n FROM s),
    r AS (SELECT replicate, bin, rank() OVER (PARTITION BY bin ORDER BY value) + (count(*) OVER (PARTITION BY bin, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY bin) AS n FROM s),
    a AS (SELECT replicate, list_sort(list(least(r, n + 1 - r))) AS v, any_value(n) AS n FROM r GROUP BY 1), d AS (SELECT replicate, (rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0) / n AS depth, n FROM a)
    SELECT replicate::BIGINT AS replicate, (round(depth + 3.7e-9, 6) + 0.0)::DOUBLE AS depth, (round((SELECT count(*) FROM d WHERE depth <= (SELECT depth FROM d WHERE replicate = 0)) / n + 3.7e-9, 6) + 0.0)::DOUBLE AS p_global FROM d""")
def envelope_depths(t):
    curves = t("orders").groupBy((F.col("o_custkey") % 20).cast("long").alias("replicate"), F.quarter("o_orderdate").alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("family", F.lit(1))
    return envelope(curves, ["family"], 0.2).select("replicate", "depth", "p_global")


_SC = "s AS (SELECT lang, quality AS label, round(least(n_chars, 20000) / 20000.0, 3) AS score FROM documents JOIN labels USING (doc_id))"


def _scores(t):
    return t("documents").join(t("labels"), "doc_id").select("lang", F.col("quality").alias("label"), F.round(F.least("n_chars", F.lit(20000)) / 20000.0, 3).alias("score"))


@table_query(f"""WITH {_SC}, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS r FROM s)
    SELECT lang, count(*) AS n, sum(label)::BIGINT AS positives, {q('(sum(label * r) - sum(label) * (sum(label) + 1) / 2) / nullif((sum(label) * (count(*) - sum(label)))::DOUBLE, 0)')} AS auroc, {q('avg((score - label) * (score - label))')} AS brier FROM r GROUP BY 1""")
def auroc_and_brier(t):
    return cohort.auroc(_scores(t), "lang")


@table_query(f"""WITH {_SC}, a AS (SELECT lang, score, count(*) AS k, sum(label) AS p FROM s GROUP BY 1, 2), c AS (SELECT lang, p, sum(p) OVER w AS tp, sum(k) OVER w AS n FROM a WINDOW w AS (PARTITION BY lang ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    SELECT lang, {q('sum(tp / n * p) / nullif(sum(p), 0)')} AS average_precision FROM c GROUP BY 1""")
def average_precision(t):
    return cohort.average_precision(_scores(t), "lang")


@table_query(f"""WITH {_SC} SELECT lang, least(floor(score * 10), 9)::INT AS bin, count(*) AS n, {q('avg(score)')} AS mean_score, {q('avg(label)')} AS share FROM s GROUP BY 1, 2""")
def reliability(t):
    return cohort.reliability(_scores(t), 10, "lang")


@table_query(f"""WITH e AS (SELECT label, unnest(range(1, 65)) - 1 AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, pos::INT AS pos, {q('avg(v)')} AS mean FROM e GROUP BY 1, 2""")
def mean_embeddings(t):
    return embedding.mean_vectors(t("embeddings"), "embedding", F.lit(1.0), "label")


@table_query(f"""WITH e AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings), g AS (SELECT label, pos, var_pop(v) AS var, count(*) AS n FROM e GROUP BY 1, 2) SELECT label, max(n) AS n, {q('sum(var)')} AS dispersion FROM g GROUP BY 1""")
def embedding_dispersion(t):
    return embedding.dispersion(t("embeddings"), "embedding", "label")


@table_query(f"""WITH d AS (SELECT a.vec_id AS query, b.vec_id AS found, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d2 FROM embeddings a JOIN embeddings b ON a.label <> b.label WHERE a.vec_id % 50 = 0)
    SELECT query::BIGINT AS query, found::BIGINT AS found, {q('d2')} AS d2, row_number() OVER (PARTITION BY query ORDER BY d2, found)::INT AS rank FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY d2, found) <= 5""")
def region_retrieval(t):
    """The nearest vectors of another label, for each vector whose id is divisible by 50, against all."""
    e = t("embeddings")
    return embedding.retrieve(e.where(F.col("vec_id") % 50 == 0), e, "embedding", 5, "vec_id", "label")


@table_query(f"""WITH b AS (SELECT event_type, floor((event_id % 1000) / 50.0)::BIGINT AS bin, sum(abs(value)) AS total, sum(sqrt(abs(value))) AS root, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, bin, {q('total')} AS total, {q('root')} AS root, n, {q('total / sum(total) OVER (PARTITION BY event_type)')} AS share FROM b""")
def spectrum_bins(t):
    peaks = t("events").select("event_type", (F.col("event_id") % 1000).alias("mz"), F.abs("value").alias("intensity"))
    return tables.binned_spectrum(peaks, 50.0, "mz", "intensity", "event_type")


@table_query(f"""WITH RECURSIVE e AS (SELECT user_id::BIGINT AS series, event_id::BIGINT AS t, value::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    f AS (SELECT series, t, k, n, 0.0::DOUBLE AS pm, 10.0::DOUBLE AS pv, 10.0 / 14.0 * y AS m, (1 - 10.0 / 14.0) * 10.0 AS v, -0.5 * (ln(2 * pi() * 14.0) + y * y / 14.0) AS ll FROM e WHERE k = 1
      UNION ALL SELECT series, t, k, n, pm, pv, pm + pv / (pv + 4) * (y - pm), (1 - pv / (pv + 4)) * pv, ll - 0.5 * (ln(2 * pi() * (pv + 4)) + (y - pm) * (y - pm) / (pv + 4)) FROM (SELECT e.series, e.t, e.k, e.n, e.y, 0.9 * f.m AS pm, 0.81 * f.v + 1 AS pv, f.ll FROM f JOIN e ON e.series = f.series AND e.k = f.k + 1)),
    g AS (SELECT series, k, m AS sm, v AS sv FROM f WHERE k = n UNION ALL SELECT a.series, a.k, a.m + a.v * 0.9 / b.pv * (g.sm - b.pm), a.v + pow(a.v * 0.9 / b.pv, 2) * (g.sv - b.pv) FROM g JOIN f b ON b.series = g.series AND b.k = g.k JOIN f a ON a.series = g.series AND a.k = g.k - 1)
    SELECT f.series, f.t, {q('f.m')} AS filtered, {q('g.sm')} AS smoothed, {q('g.sv')} AS smoothed_variance, {q('max(f.ll) FILTER (f.k = f.n) OVER (PARTITION BY f.series)')} AS log_likelihood FROM f JOIN g USING (series, k)""")
def kalman_smoother(t):
    e = t("events").select(F.col("user_id").cast("long").alias("series"), F.col("event_id").cast("long").alias("t"), F.col("value").cast("double"))
    return models.kalman(e, 0.9, 1.0, 4.0, 0.0, 10.0)


def transport_sql(give: str, la: str, lb: str) -> str:
    """Entropic plans between nations of a region by supplier counts, 500 rounds; marginals are scaled by `give`."""
    soft = lambda x, other, k: f"ln(list_sum(list_transform({other}, lambda v, w: exp({k} + v))))"
    f = f"list_transform(la, lambda a, i: {give} * (a - {soft('a', 'g', 'kk[i][w]')}))"
    g = f"list_transform(lb, lambda b, j: {give} * (b - {soft('b', 'f', 'kk[w][j]')}))"
    return f"""WITH RECURSIVE m AS (SELECT n_regionkey::BIGINT AS problem, n_nationkey::BIGINT AS nation, count(*)::DOUBLE AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), t AS (SELECT problem, sum(m) AS t FROM m GROUP BY 1),
    pa AS (SELECT problem, list(nation ORDER BY nation) AS ids, list({la} ORDER BY nation) AS la, list({lb} ORDER BY nation) AS lb FROM m JOIN t USING (problem) GROUP BY 1), pk AS (SELECT *, list_transform(ids, lambda s: list_transform(ids, lambda t: -abs(s - t)::DOUBLE)) AS kk FROM pa),
    st AS (SELECT problem, 0 AS n, list_transform(ids, lambda s: 0.0::DOUBLE) AS f, list_transform(ids, lambda s: 0.0::DOUBLE) AS g FROM pk UNION ALL SELECT problem, n + 1, f, {g} AS g FROM (SELECT st.problem, n, la, lb, kk, {f} AS f FROM st JOIN pk USING (problem) WHERE n < 500)),
    fi AS (SELECT problem, ids, kk, f, g FROM st JOIN pk USING (problem) WHERE n = 500), ix AS (SELECT problem, ids, kk, f, g, unnest(range(1, len(ids) + 1)) AS i FROM fi), ij AS (SELECT *, unnest(range(1, len(ids) + 1)) AS j FROM ix)
    SELECT problem, ids[i] AS source, ids[j] AS target, {q('exp(kk[i][j] + f[i] + g[j])')} AS mass FROM ij"""


@table_query(transport_sql("1.0", "ln(m / t)", "ln(m / t)"))
def sinkhorn_plan(t):
    s = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    mass = s.groupBy(F.col("n_regionkey").cast("long").alias("problem"), F.col("n_nationkey").cast("long").alias("nation")).agg(F.count(F.lit(1)).cast("double").alias("m"))
    other = mass.withColumnsRenamed({"nation": "target", "m": "b"})
    costs = mass.withColumnsRenamed({"nation": "source", "m": "a"}).join(other, "problem").withColumn("cost", F.abs(F.col("source") - F.col("target")).cast("double"))
    return models.sinkhorn(costs, 1.0, 500)


@query(f"""WITH {PTS}, n AS (SELECT pattern_id, count(*) AS n FROM pts GROUP BY 1), g AS (SELECT pattern_id, unnest(range(n)) AS idx FROM n) SELECT pattern_id, idx, {q(f"1000 * {unit(7, 'pattern_id', 'idx')}")} AS x, {q(f"1000 * {unit(8, 'pattern_id', 'idx')}")} AS y FROM g""")
def conditional_csr(pts):
    return models.uniform_points(pts.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n")), WINDOW, 7)


@query(f"""WITH {PTS}, {PR}, u AS (SELECT pattern_id, i AS idx, jl AS l FROM pr WHERE d2 <= 900 UNION ALL SELECT pattern_id, idx, label FROM pts)
    SELECT pattern_id, idx, count(*) AS members, {q("avg((l = 'A')::INT)")} AS "share_A", {q("avg((l = 'N')::INT)")} AS "share_N", {q("avg((l = 'R')::INT)")} AS "share_R" FROM u GROUP BY 1, 2""")
def disc_census(pts):
    return neighbourhood.disc_census(pts, 30.0, ["A", "N", "R"])


@query(f"""WITH {PTS}, {PR} SELECT pattern_id, i AS idx, {q('avg(jm)')} AS share, CASE WHEN any_value(im) = 1 THEN 'treated' ELSE 'control' END || '_' || CASE WHEN avg(jm) >= 0.5 THEN 'high' ELSE 'low' END AS exposure FROM pr GROUP BY 1, 2""")
def exposure_mapping(pts):
    return neighbourhood.exposure(pts, R, 0.5)


@query(f"""{BASE}, {_N}, c AS (SELECT pattern_id, r, count(*) AS pairs FROM pr, rs WHERE i < j AND d2 + (iz - jz) * (iz - jz) <= r * r GROUP BY 1, 2)
    SELECT pattern_id, n, r, coalesce(pairs, 0) AS pairs, CASE WHEN n > 1 THEN {q('2 * 1000000000.0 * coalesce(pairs, 0) / (n * (n - 1))')} END AS k FROM n CROSS JOIN rs LEFT JOIN c USING (pattern_id, r)""")
def homogeneous_k3d(pts):
    return neighbourhood.k_3d(pts, RADII, 1e9)


@query(f"""WITH {PTS}, {PR}, b AS (SELECT * FROM (VALUES (0, 0.0, 15.0, false), (1, 15.0, 30.0, false), (2, 30.0, 50.0, true)) t(bin, lo, hi, closed)),
    c AS (SELECT pattern_id, bin, count(*) AS pairs, avg(0.5 * ((ipa - jpa) * (ipa - jpa) + (ipb - jpb) * (ipb - jpb) + (ipc - jpc) * (ipc - jpc))) AS gamma FROM pr, b WHERE i < j AND d2 >= lo * lo AND (d2 < hi * hi OR closed AND d2 <= hi * hi) GROUP BY 1, 2)
    SELECT pattern_id, bin::INT AS bin, coalesce(pairs, 0) AS pairs, {q('gamma')} AS gamma FROM (SELECT DISTINCT pattern_id FROM pts) CROSS JOIN b LEFT JOIN c USING (pattern_id, bin)""")
def vector_semivariogram(pts):
    return embedding.vector_semivariogram(pts.withColumn("vec", F.array("pa", "pb", "pc")), "vec", [0.0, 15.0, 30.0, 50.0])


@query(f"""WITH {PTS}, s AS (SELECT pattern_id, count(*) AS n, avg(mark) AS p, coalesce(avg(value) FILTER (mark = 1), 0) AS y1, coalesce(avg(value) FILTER (mark = 0), 0) AS y0 FROM pts GROUP BY 1)
    SELECT pattern_id, n, {q('y1 * p + 0 * (1 - p) - y0 * (1 - p) - 50 * p')} AS lower, {q('y1 * p + 50 * (1 - p) - y0 * (1 - p) - 0 * p')} AS upper FROM s""")
def manski_bounds(pts):
    return cohort.manski_bounds(pts, 0.0, 50.0, "pattern_id", treated="mark", outcome="value")


@query(f"""WITH {PTS}, {PR}, zz AS (SELECT pattern_id, idx, value - avg(value) OVER (PARTITION BY pattern_id) AS z FROM pts), ss AS (SELECT pattern_id, count(*) AS n, sum(z * z) AS s FROM zz GROUP BY 1),
    {shuffle('sz', 'zz', 'pattern_id', 'idx', 'z', 99, 123456789)}, al AS (SELECT pattern_id, replicate, idx, z FROM sz UNION ALL SELECT pattern_id, 0, idx, z FROM zz), ed AS (SELECT pattern_id, i, j FROM pr WHERE i < j), en AS (SELECT pattern_id, count(*) AS w FROM ed GROUP BY 1),
    mi AS (SELECT e.pattern_id, a.replicate, sum(a.z * b.z) AS c FROM ed e JOIN al a ON a.pattern_id = e.pattern_id AND a.idx = e.i JOIN al b ON b.pattern_id = e.pattern_id AND b.idx = e.j AND b.replicate = a.replicate GROUP BY 1, 2),
    st AS (SELECT pattern_id, replicate, n / w / s * c AS v FROM mi JOIN en USING (pattern_id) JOIN ss USING (pattern_id) WHERE s > 0), ob AS (SELECT pattern_id, v AS seen FROM st WHERE replicate = 0)
    SELECT u.pattern_id, {q('any_value(seen)')} AS moran_i, CASE WHEN count(v) > 0 THEN {q('(1 + count(*) FILTER (v >= seen - 1e-12)) / 100.0')} END AS p_high, 99 AS replicates FROM (SELECT DISTINCT pattern_id FROM pts) u LEFT JOIN ob USING (pattern_id) LEFT JOIN (SELECT * FROM st WHERE replicate > 0) USING (pattern_id) GROUP BY 1""")
def moran_permutation(pts):
    return neighbourhood.moran_permutation(pts, R, 99, 123456789)


@query(f"""WITH {PTS}, a AS (SELECT pattern_id, count(*) AS n, avg(value) AS y, avg(mark) AS g, avg(pa) AS c, var_pop(pa) * count(*) AS cc, covar_pop(pa, value) * count(*) AS cy, covar_pop(pa, mark) * count(*) AS cg FROM pts GROUP BY 1),
    r AS (SELECT pattern_id, idx, n, cc, pa - a.c AS c, value - a.y - cy / cc * (pa - a.c) AS e, mark - a.g - cg / cc * (pa - a.c) AS h FROM pts JOIN a USING (pattern_id) WHERE cc > 0), {shuffle('se', 'r', 'pattern_id', 'idx', 'e', 99, 123456789)},
    al AS (SELECT pattern_id, 0 AS replicate, idx, e FROM r UNION ALL SELECT pattern_id, replicate, idx, e FROM se),
    s AS (SELECT pattern_id, replicate, max(n) AS n, sum(h * h) AS hh, sum(h * al.e) AS he, sum(al.e * al.e) AS ee, sum(al.e) AS e1, sum(c * al.e) AS ce, max(cc) AS cc FROM al JOIN (SELECT pattern_id, idx, n, c, h, cc FROM r) USING (pattern_id, idx) GROUP BY 1, 2),
    t AS (SELECT pattern_id, replicate, he / hh AS b, he / hh / sqrt((ee - e1 * e1 / n - ce * ce / cc - he * he / hh) / (n - 3) / hh) AS t FROM s WHERE hh > 1e-9 AND n > 3), o AS (SELECT pattern_id, b, t AS seen FROM t WHERE replicate = 0)
    SELECT u.pattern_id, {q('any_value(b)')} AS coefficient, {q('any_value(seen)')} AS t, CASE WHEN count(t) > 0 THEN {q('(1 + count(*) FILTER (abs(t) >= abs(seen) - 1e-12)) / 100.0')} END AS p FROM (SELECT DISTINCT pattern_id FROM pts) u LEFT JOIN o USING (pattern_id) LEFT JOIN (SELECT pattern_id, t FROM t WHERE replicate > 0) USING (pattern_id) GROUP BY 1""")
def covariate_permutation(pts):
    return cohort.freedman_lane(pts.select("pattern_id", "idx", "value", (F.col("mark") == 1).alias("is_first"), "pa"), 99, 123456789, "pattern_id", covariates=["pa"], id_col="idx")
