"""Hand-computed answers and brute force for the spatial building blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import core, seeds
from tessella.operators import cohort, groups, models, morphology, neighbourhood, point_process, tables
from tessella.sources import cells

SCHEMA = "pattern_id long, idx long, x double, y double, mark int, label string, value double"
WINDOW = (0.0, 0.0, 10.0, 10.0)


def frame(spark, rows):
    return spark.createDataFrame([(1, i, float(x), float(y), m, l, float(v)) for i, (x, y, m, l, v) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def cloud(spark):
    random.seed(5)
    rows = [(random.randint(0, 100) / 10, random.randint(0, 100) / 10, random.randint(0, 1), random.choice("abc"), random.random()) for _ in range(120)]
    return rows, frame(spark, rows)


def test_pairs_match_brute_force_with_coincident_points(spark, cloud):
    rows, df = cloud
    want = {(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 <= 1.5**2}
    assert {(r.i, r.j) for r in core.pairs(df, None, 1.5).collect()} == want
    assert {(r.i, r.j) for r in core.pairs(df, None, 1.5, unordered=True).collect()} == {p for p in want if p[0] < p[1]}


def test_pairs_do_not_plan_a_cross_join(spark, cloud):
    plan = core.pairs(cloud[1], None, 1.5)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_cooccurrence_known_answer(spark):
    df = frame(spark, [(0, 0, 0, "a", 0), (0, 0, 0, "b", 0), (1, 0, 0, "a", 0), (3, 0, 0, "c", 0)])
    got = {(r.r, r.a, r.b): (r.pairs, r.score) for r in neighbourhood.cooccurrence(df, [0.5, 2.0]).collect()}
    assert got[0.5, "a", "b"] == (1, 2.0) and got[0.5, "a", "c"] == (0, None)
    assert sum(n for (r, *_), (n, _) in got.items() if r == 0.5) == 2 and sum(n for (r, *_), (n, _) in got.items() if r == 2.0) == 8


def test_border_g_known_answer(spark):
    df = frame(spark, [(2 + k, 5, 0, "a", 0) for k in range(3)])
    got = point_process.border_g(df, [1.0], 0.5, WINDOW).first()
    assert got.eligible == 3 and math.isclose(got.g, 100 * 4 * 0.75 / 0.5 / (2 * math.pi * 3 * 3))


def test_envelope_matches_brute_force(spark):
    random.seed(1)
    curves = [[random.randint(0, 4) for _ in range(5)] for _ in range(10)]
    df = spark.createDataFrame([(1, k, b, float(v)) for k, c in enumerate(curves) for b, v in enumerate(c)], "fam int, replicate int, bin int, value double")
    got = {r.replicate: r for r in core.envelope(df, ["fam"], 0.2).collect()}
    rank = lambda xs, x: sum(v < x for v in xs) + (sum(v == x for v in xs) + 1) / 2
    vectors = [sorted(min(r := rank([c[b] for c in curves], own[b]), 11 - r) for b in range(5)) for own in curves]
    depth = [rank(vectors, v) / 10 for v in vectors]
    assert [got[k].depth for k in range(10)] == pytest.approx(depth)
    assert got[0].p_global == pytest.approx(sum(d <= depth[0] for d in depth) / 10)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.5)], "i int, p double").withColumn("f", F.lit(1))
    got = {r.i: r.q for r in core.benjamini_hochberg(df, "p", "i", "f").collect()}
    assert got == pytest.approx({0: 0.04, 1: 0.16 / 3, 2: 0.16 / 3, 3: 0.5})


def test_shuffles_are_permutations_and_repeatable():
    s = seeds.replicate_seeds(1, 2, 50)
    a, b = seeds.shuffles(20, s), seeds.shuffles(20, s[:10])
    assert (np.sort(a, axis=1) == np.arange(20)).all() and (a[:10] == b).all() and len({tuple(x) for x in a}) == 50


def test_information_of_copies_and_xor(spark):
    rows = spark.createDataFrame([(1, a, b, a ^ b, a) for a in (0, 1) for b in (0, 1)], "pattern_id int, a int, b int, x int, c int")
    co = lambda *v: tables.joint_information(rows, v, "pattern_id").first().co_information
    assert co("a", "c") == pytest.approx(1) and co("a", "b", "x") == pytest.approx(-1)
    d = tables.redundancy(rows, "x", "a", "b", "pattern_id").first()
    assert d.synergy == pytest.approx(1) and d.shared == pytest.approx(0)


def test_enrichment_moments_by_enumeration(spark):
    from itertools import permutations

    rows = [(0, 0, 0, "a", 0), (1, 0, 0, "a", 0), (1, 1, 0, "b", 0), (3, 0, 0, "b", 0), (3.5, 0, 0, "c", 0)]
    edges = [(i, j) for i in range(5) for j in range(i + 1, 5) if (rows[i][0] - rows[j][0]) ** 2 + (rows[i][1] - rows[j][1]) ** 2 <= 2.25]
    for r in neighbourhood.enrichment(frame(spark, rows), 1.5).collect():
        n = [sum(tuple(sorted((p[i], p[j]))) == (r.a, r.b) for i, j in edges) for p in permutations("aabbc")]
        assert r.mean == pytest.approx(np.mean(n)) and r.variance == pytest.approx(np.var(n), abs=1e-9)


def test_density_clusters(spark):
    rows = [(k, 0, 0, "a", 0) for k in range(5)] + [(9, 9, 0, "a", 0)]
    got = {r.idx: (r.cluster, r.core) for r in neighbourhood.density_clusters(frame(spark, rows), 1.0, 3).collect()}
    assert got == {0: (1, False), 1: (1, True), 2: (1, True), 3: (1, True), 4: (1, False)}


def test_student_t_tail():
    assert cohort._t_tail(0, 5) == pytest.approx(0.5) and cohort._t_tail(2.015048, 5) == pytest.approx(0.05, abs=1e-6) and cohort._t_tail(-1.812461, 10) == pytest.approx(0.95, abs=1e-6)


def test_sinkhorn_keeps_marginals(spark):
    df = spark.createDataFrame([(1, i, j, float(i + 1), float(j + 1), abs(i - j) * 1.0) for i in range(3) for j in range(3)], "problem long, source long, target long, a double, b double, cost double")
    got = models.sinkhorn(df, 0.5, 2000).toPandas()
    assert got.groupby("source").mass.sum().tolist() == pytest.approx([1 / 6, 2 / 6, 3 / 6], abs=1e-6)


def test_kalman_with_missing_values(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([1.0, None, 2.0])], "series long, t long, value double")
    got = models.kalman(df, 1.0, 0.0, 1.0, 0.0, 1.0).orderBy("t").toPandas()
    # without process noise all smoothed means are that of a static state: (1 + 2) / 3
    assert got.smoothed.tolist() == pytest.approx([1.0, 1.0, 1.0]) and got.smoothed_variance.tolist() == pytest.approx([1 / 3] * 3)


def test_window_with_a_hole(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text('{"type": "Polygon", "coordinates": [[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}')
    edges = cells.read_window(spark, f"file://{path}")
    area = cells.polygon_area(edges).first()
    assert (area.area, area.perimeter) == (96, 48)
    pts = spark.createDataFrame([(1.0, 2.0), (5.0, 5.0), (4.0, 5.0), (11.0, 5.0), (10.0, 3.0)], "x double, y double")
    got = {(r.x, r.y): (r.inside, r.boundary_distance) for r in cells.in_window(pts, edges).collect()}
    assert got == {(1, 2): (True, 1), (5, 5): (False, 1), (4, 5): (True, 0), (11, 5): (False, 1), (10, 3): (True, 0)}


def test_permuted_moran_keeps_the_observed_value(spark, cloud):
    a, b = neighbourhood.moran_permutation(cloud[1], 1.5, 99, 3).first(), point_process.moran(cloud[1], 1.5).first()
    assert a.moran_i == pytest.approx(b.moran_i) and 0.01 <= a.p_high <= 1
    again = neighbourhood.moran_permutation(cloud[1].repartition(7, "idx"), 1.5, 99, 3).first()
    assert again == a


def test_covariate_permutation_finds_a_group_effect(spark):
    rng = np.random.default_rng(2)
    rows = [(1, float(5 * (i % 2) + 3 * c + rng.normal()), bool(i % 2), float(c)) for i, c in enumerate(rng.normal(size=60))]
    got = cohort.freedman_lane(spark.createDataFrame(rows, "unit int, value double, is_first boolean, c double"), 99, 1, "unit", covariates=["c"]).first()
    assert got.coefficient == pytest.approx(5, abs=1) and got.p == 0.01


def test_isotropic_weights_of_a_corner_and_an_edge(spark):
    pts = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 1.0, 0.0), (2, 1, 5.0, 5.0), (2, 2, 5.0, 6.0)], "pattern_id long, idx long, x double, y double")
    got = {r.pattern_id: r.k for r in point_process.isotropic_k(pts, [2.0], (0.0, 0.0, 10.0, 10.0)).collect()}
    # a quarter of the corner's circle lies inside, half of that of a point one radius along the edge
    assert got[1] == pytest.approx(100 * (4 + 2) / 2)
    assert got[2] == pytest.approx(100 * (1 + 1) / 2)
    with pytest.raises(ValueError):
        point_process.isotropic_k(pts, [6.0], (0.0, 0.0, 10.0, 10.0))


def test_raster_with_a_hole_and_its_boxes(spark):
    ring = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    pts = spark.createDataFrame([(1, k, x + 0.5, y + 0.5) for k, (x, y) in enumerate(ring)], "pattern_id long, idx long, x double, y double")
    r = morphology.raster_morphology(pts, 1.0).first()
    assert (r.area, r.perimeter, r.euler) == (8.0, 16.0, 0)
    boxes = {r.size: r.lacunarity for r in morphology.lacunarity(pts, 1.0, 3, [1, 3]).collect()}
    assert boxes == {1: pytest.approx(8 / 9 / (8 / 9) ** 2), 3: pytest.approx(1.0)}


def test_landmarks_turned_and_moved_fit_without_residual(spark):
    marks = [(1, x, y, -y + 3.0, x - 2.0) for x, y in ((0.0, 0.0), (1.0, 0.0), (0.0, 2.0), (3.0, 1.0))]
    line = [(2, float(x), float(x), 0.0, 0.0) for x in range(3)]
    got = {r.pattern_id: r for r in morphology.landmark_fits(spark.createDataFrame(marks + line, "pattern_id long, x double, y double, u double, v double")).collect()}
    r = got[1]
    assert (r.theta, r.shift_x, r.shift_y, r.b, r.f) == pytest.approx((np.pi / 2, 3.0, -2.0, -1.0, -2.0))
    assert r.rigid_rmse < 1e-6 and r.affine_rmse < 1e-6
    assert got[2].a is None  # landmarks on one line have no affine fit


def test_half_defect_in_a_ring_of_directors(spark):
    angles = [(1, 0, 0, 0.0), (1, 1, 0, 0.8), (1, 1, 1, 1.5), (1, 0, 1, 2.4)]
    field = spark.createDataFrame(angles, "pattern_id long, gx long, gy long, director double")
    assert [r.charge for r in morphology.half_defects(field).collect()] == [0.5]


def test_energy_distance_and_mmd_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 6, 9).astype(float), rng.integers(2, 9, 7).astype(float)
    rows = spark.createDataFrame([(1, True, float(x)) for x in a] + [(1, False, float(x)) for x in b] + [(2, True, 1.0)], "site int, is_first boolean, value double")
    gap = lambda p, q: np.abs(p[:, None] - q[None]).mean()
    assert [(r.site, pytest.approx(r.energy)) for r in groups.energy_distance(rows, "site").collect()] == [(1, 2 * gap(a, b) - gap(a, a) - gap(b, b))]
    u, v = rng.normal(size=(5, 3)), rng.normal(size=(4, 3))
    vectors = spark.createDataFrame([(0, x.tolist()) for x in u] + [(1, x.tolist()) for x in v], "label int, v array<double>")
    r = groups.linear_mmd(vectors, "label", "v", 0).first()
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    assert r.biased == pytest.approx(((u.mean(0) - v.mean(0)) ** 2).sum())
    assert r.unbiased == pytest.approx(off(u @ u.T) + off(v @ v.T) - 2 * (u @ v.T).mean())


def test_conformal_quantile_of_a_small_group_is_null(spark):
    rows = spark.createDataFrame([("a", k / 20) for k in range(19)] + [("b", 0.5)], "g string, score double")
    assert {r.g: r.quantile for r in groups.conformal_quantiles(rows, "g", "score", 0.1).collect()} == {"a": 17 / 20, "b": None}
