"""Nulls, local prediction, samplers and dynamics against direct computations."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import dynamics, graphs, groups, inference, models, point_process, tables


@pytest.fixture(scope="module")
def cloud(spark):
    random.seed(8)
    rows = [(1, k, random.random() * 10, random.random() * 10, random.choice("ab"), random.random()) for k in range(40)] + [(2, 0, 1.0, 1.0, "a", 0.5)]
    return rows, spark.createDataFrame(rows, "pattern_id long, idx long, x double, y double, label string, value double")


def test_step_down_is_monotone_and_below_single_step(spark):
    null = spark.createDataFrame([(e, r, s) for e, stats in {"a": [3.0, 1, 3, 0, 1], "b": [2.0, 1, 1, 2, 0], "c": [-1.0, 5, 0, 0, 0]}.items() for r, s in enumerate(map(float, stats))], "e string, replicate int, statistic double")
    got = {r.e: r.p_adjusted for r in inference.step_down(null, "e").collect()}
    # maxima over c: 5 0 0 0; over c, b: 5 1 2 0; over all: 5 3 2 1
    assert got == {"a": 3 / 5, "b": 3 / 5, "c": 3 / 5}


def test_sign_flips_approach_the_exact_p(spark):
    d = [0.5, 1.5, -0.25, 2.0, 1.0, 0.75]
    rows = spark.createDataFrame([(7, x) for x in d] + [(7, None)], "unit int, difference double")
    r = inference.sign_flips(rows, 4000, 3, "unit").first()
    exact = np.mean([abs(np.dot(s, d)) >= sum(d) - 1e-12 for s in itertools.product((-1, 1), repeat=6)])
    assert (r.unit, r.n) == (7, 6) and r.p == pytest.approx(exact, abs=0.015)


def test_bootstrap_interval_holds_the_mean_and_ignores_order(spark):
    rows = spark.createDataFrame([(1, k % 7, float(k)) for k in range(70)], "unit int, c int, value double")
    a, b = (inference.bootstrap_mean(x, 500, 2, 0.1, "unit", "c").first() for x in (rows, rows.orderBy(F.desc("value")).repartition(5)))
    assert a == b and a.clusters == 7 and a.low < a.mean < a.high


def test_shuffled_enrichment_counts_edges_and_keeps_strata(spark, cloud):
    rows, df = cloud
    got = {(r.pattern_id, r.a, r.b): r for r in inference.shuffled_enrichment(df, 2.0, 300, 1).collect()}
    one = rows[:40]
    want = {}
    for p, q in itertools.combinations(one, 2):
        if (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= 4:
            key = tuple(sorted((p[4], q[4])))
            want[key] = want.get(key, 0) + 1
    assert {k[1:]: r.edges for k, r in got.items() if k[0] == 1 and r.edges} == want
    n, na, edges = 40, sum(r[4] == "a" for r in one), sum(want.values())
    assert got[1, "a", "a"].mean == pytest.approx(edges * na * (na - 1) / (n * (n - 1)), rel=0.1)
    assert got[2, "a", "a"].ratio is None and got[2, "a", "a"].p_high == 1
    fixed = inference.shuffled_enrichment(df.withColumn("s", F.col("label")), 2.0, 20, 1, stratum="s").where("edges > 0").collect()
    assert all(r.mean == r.edges and r.z is None for r in fixed)  # labels that can't move


def test_kriging_solves_the_system_and_meets_a_datum(spark, cloud):
    rows, df = cloud
    targets = spark.createDataFrame([(1, 0, 5.0, 5.0), (1, 1, rows[0][2], rows[0][3]), (3, 0, 0.0, 0.0)], "pattern_id long, idx long, x double, y double")
    got = {(r.pattern_id, r.idx): r for r in inference.kriging(df, targets, 20.0, 6, 2.0, 3.0, 0.0).collect()}
    near = sorted(rows[:40], key=lambda r: math.hypot(r[2] - 5, r[3] - 5))[:6]
    p, v = np.array([r[2:4] for r in near]), np.array([r[5] for r in near])
    c = 2 * np.exp(-np.linalg.norm(p[:, None] - p[None], axis=2) / 3)
    inverse, one, c0 = np.linalg.inv(c), np.ones(6), 2 * np.exp(-np.linalg.norm(p - 5, axis=1) / 3)
    trend = one @ inverse @ v / (one @ inverse @ one)
    assert got[1, 0].mean == pytest.approx(trend + c0 @ inverse @ (v - trend))
    assert got[1, 1].mean == pytest.approx(rows[0][5]) and got[1, 1].variance == pytest.approx(0, abs=1e-9)
    assert (got[3, 0].neighbours, got[3, 0].mean, got[3, 0].variance) == (0, None, None)


def test_neighbour_information_of_a_gaussian_pair(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(1500, 2))
    x, y = z[:, 0], 0.9 * z[:, 0] + math.sqrt(1 - 0.81) * z[:, 1]
    df = spark.createDataFrame([(1, k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))] + [(2, 0, 1.0, 2.0)], "pattern_id long, idx long, a double, b double")
    got = {r.pattern_id: r.information for r in inference.neighbour_information(df, "a", "b", 3).collect()}
    assert got[1] == pytest.approx(-math.log(1 - 0.81) / 2, abs=0.08) and got[2] is None


def test_merge_curve_counts_components(spark):
    df = spark.createDataFrame([(1, k, x, 0.0) for k, x in enumerate((0.0, 1.0, 3.0, 7.0))] + [(2, 0, 0.0, 0.0)], "pattern_id long, idx long, x double, y double")
    got = {(r.pattern_id, r.r): (r.components, r.largest_share) for r in inference.merge_curve(df, [4.0, 0.5, 1.0, 2.0]).collect()}
    assert [got[1, r] for r in (0.5, 1.0, 2.0, 4.0)] == [(4, 0.25), (3, 0.5), (2, 0.75), (1, 1.0)] and got[2, 4.0] == (1, 1.0)


def test_chebyshev_heat_equals_the_exponential(spark, cloud):
    rows, df = cloud
    one = rows[:40]
    a = np.array([[float(p is not q and math.hypot(p[2] - q[2], p[3] - q[3]) <= 1.5) for q in one] for p in one])
    deg = a.sum(1)
    s = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1)), 0)
    w, v = np.linalg.eigh(np.eye(40) - s[:, None] * a * s)
    want = v @ (np.exp(-0.8 * w) * (v.T @ np.array([r[5] for r in one])))
    got = {(r.pattern_id, r.idx): r.heat for r in dynamics.chebyshev_heat(df, 1.5, 0.8, 8).collect()}
    assert [got[1, k] for k in range(40)] == pytest.approx(want.tolist(), abs=1e-6)
    assert got[2, 0] == pytest.approx(0.5 * math.exp(-0.8), abs=1e-6)


def test_hamiltonian_draws_find_the_conjugate_posterior(spark):
    s = spark.createDataFrame([(1, 30, 66.0), (2, 0, 0.0)], "unit long, n long, s double")
    got = {r.unit: r for r in inference.hamiltonian_mean(s, "unit", 0.0, 4.0, 9.0, 4000, 5).collect()}
    w = 1 / 4 + 30 / 9
    assert got[1].mean == pytest.approx(66 / 9 / w, abs=0.06) and got[1].deviation == pytest.approx(w**-0.5, abs=0.06)
    assert got[2].mean == pytest.approx(0, abs=0.25) and got[2].deviation == pytest.approx(2, abs=0.2) and got[1].acceptance > 0.8


def test_growth_front_moves_at_the_linear_speed_and_guards_its_step(spark):
    s = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.25, 1.0)], "key long, rate double, diffusion double")
    early, late = ({r.key: r.front for r in dynamics.growth_front(s, 300, 1.0, 0.05, n).collect()} for n in (600, 1800))
    for key, speed in ((1, 2.0), (2, 1.0)):
        assert (late[key] - early[key]) / 60 == pytest.approx(speed, rel=0.08)
    with pytest.raises(Exception, match="time step"):
        dynamics.growth_front(s, 10, 1.0, 0.6, 1).collect()


def test_competition_reaches_its_equilibria(spark):
    s = spark.createDataFrame([(1, 0.5, 0.5, 0.1, 0.3), (2, 2.0, 0.5, 0.5, 0.5)], "key long, a double, b double, x double, y double")
    got = {r.key: (r.x, r.y) for r in dynamics.competition(s, 0.1, 2000).collect()}
    assert got[1] == pytest.approx((2 / 3, 2 / 3)) and got[2] == pytest.approx((0.0, 1.0), abs=1e-6)


def test_particle_filter_follows_the_linear_filter(spark):
    rows = [(1, t, v) for t, v in enumerate([1.0, 1.4, None, 2.0, 1.1])]
    df = spark.createDataFrame(rows, "series long, t long, value double")
    got = [r.mean for r in dynamics.particle_filter(df, 0.9, 0.5, 0.4, 0.0, 2.0, 20000, 4).orderBy("t").collect()]
    m, p, want = 0.0, 2.0, []
    for t, (_, _, v) in enumerate(rows):
        if t:
            m, p = 0.9 * m, 0.81 * p + 0.5
        if v is not None:
            k = p / (p + 0.4)
            m, p = m + k * (v - m), (1 - k) * p
        want.append(m)
    assert got == pytest.approx(want, abs=0.03)


def test_rejection_growth_brackets_the_rate(spark):
    df = spark.createDataFrame([(1, t, math.exp(1.3 * t)) for t in (0.5, 1.0, 1.5, 2.0)] + [(2, 1.0, 1e9)], "key long, t double, value double")
    got = {r.key: r for r in dynamics.rejection_growth(df, 0.0, 3.0, 600, 0.1).collect()}
    assert got[1].least < 1.3 < got[1].most and got[1].mean == pytest.approx(1.3, abs=0.02)
    assert got[2].accepted == 0 and got[2].mean is None


def test_shrunken_means_pool_single_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 10.0), ("b", 12.0), ("c", 6.0), ("d", None)], "unit string, value double")
    got = {r.unit: r for r in inference.shrunken_means(df, "unit").collect()}
    assert set(got) == {"a", "b", "c"} and got["c"].weight < got["a"].weight < 1
    assert 2.0 < got["a"].shrunken < got["c"].shrunken < got["b"].shrunken < 11.0


def test_cluster_labels_move_as_wholes(spark):
    rows = [(1, c, c < 3, float(10 * (c < 3) + k)) for c in range(6) for k in range(4)] + [(2, 0, True, 1.0)]
    got = {r.unit: r for r in inference.cluster_permutation(spark.createDataFrame(rows, "unit int, c int, is_first boolean, value double"), 2000, 1, "unit", "c").collect()}
    assert got[1].clusters == 6 and got[1].difference == pytest.approx(10) and got[1].p == pytest.approx(2 / 20, abs=0.03)
    assert got[2].difference is None and got[2].p is None


def test_functional_permutation_and_uneven_axes(spark):
    rows = [("e", u, float(a), u < 4, float(a * (u < 4))) for u in range(8) for a in range(3)]
    df = spark.createDataFrame(rows, "endpoint string, unit int, axis double, is_first boolean, value double")
    r = inference.functional_permutation(df, 2000, 2).first()
    assert r.units == 8 and r.statistic == pytest.approx((0 + 1) / 2 + (1 + 4) / 2) and r.p == pytest.approx(2 / 70, abs=0.015)
    with pytest.raises(Exception, match="different axes"):
        inference.functional_permutation(df.where("unit > 0 or axis > 0"), 5, 2).collect()


def test_mantel_of_equal_distances(spark, cloud):
    rows, df = cloud
    r = {x.pattern_id: x for x in inference.mantel(df.withColumn("u", F.col("x") * 2).withColumn("v", F.col("y") * 2), ["x", "y"], ["u", "v"], 99, 1).collect()}
    assert r[1].r == pytest.approx(1) and r[1].p == pytest.approx(0.01) and r[2].r is None
    with pytest.raises(Exception, match="beyond 10"):
        inference.mantel(df, ["x"], ["y"], 9, 1, most=10).collect()


def test_process_regression_equals_the_dense_density(spark, cloud):
    rows, df = cloud
    one = rows[:40]
    p, y = np.array([r[2:4] for r in one]), np.array([r[5] for r in one])
    y = y - y.mean()
    d = math.sqrt(3) * np.linalg.norm(p[:, None] - p[None], axis=2) / 2
    c = 1.5 * (1 + d) * np.exp(-d) + 0.2 * np.eye(40)
    want = -(y @ np.linalg.inv(c) @ y + np.linalg.slogdet(c)[1] + 40 * math.log(2 * math.pi)) / 2
    out = [c[k, k] and y[k] - np.delete(c[k], k) @ np.linalg.solve(np.delete(np.delete(c, k, 0), k, 1), np.delete(y, k)) for k in range(40)]
    r = inference.process_regression(df, 2.0, 1.5, 0.2).where("pattern_id = 1").first()
    assert r.log_likelihood == pytest.approx(want) and r.loo_error == pytest.approx(np.mean(np.square(out)))


def test_signal_spectrum_of_a_ring(spark):
    ring = [(1, k, math.cos(math.pi * k / 4), math.sin(math.pi * k / 4), float((-1) ** k)) for k in range(8)] + [(2, 0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(ring, "pattern_id long, idx long, x double, y double, value double")
    got = {(r.pattern_id, r.band): (r.modes, r.share) for r in graphs.signal_spectrum(df, 0.8, 4).collect()}
    assert got[1, 3][1] == pytest.approx(1) and sum(got[1, b][0] for b in range(4)) == 8 and got[2, 0] == (1, None)


def test_hodge_parts_of_a_triangle_and_a_square(spark):
    tri = [(1, 0, 0.0, 0.0, 1.0, 0.0), (1, 1, 1.0, 0.0, 2.0, 0.0), (1, 2, 0.5, 0.8, 5.0, 0.0)]
    square = [(2, k, x, y, 0.0, 1.0) for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    df = spark.createDataFrame(tri + square, "pattern_id long, idx long, x double, y double, value double, z double")
    got = {r.pattern_id: r for r in graphs.hodge_parts(df, 1.1).collect()}
    assert (got[1].triangles, got[1].gradient) == (1, pytest.approx(1))
    # flows 0-1, 1-2, 2-3, 0-3 of one: the cycle's part is (1 + 1 + 1 - 1) / 4 on each edge
    assert got[2].triangles == 0 and got[2].curl == 0 and got[2].harmonic == pytest.approx(4 * 0.25 / 4)


def test_codes_matches_boxes_and_smoothing(spark):
    rows = spark.createDataFrame([("b", 2), ("a", 3), (None, 0), (" ", 1), ("b", 9), ("c", 3)], "s string, n int")
    assert {r.level: (r.code, r.n) for r in tables.codebook(rows, "s", "n").collect()} == {"b": (0, 2), "a": (1, 1), "c": (2, 1)}
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, u string"), spark.createDataFrame([(2, 1.0), (1, 2.0)], "k int, v double")
    assert sorted(map(tuple, tables.matched(a, b, ["k"]).collect())) == [(1, "x", 2.0), (2, "y", 1.0)]
    for wrong in (b.union(b.limit(1)), b.where("k = 1")):
        with pytest.raises(Exception, match="no single match"):
            tables.matched(a, wrong, ["k"]).collect()
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 2.0), (1, 2, 1.5, 1.0)], "pattern_id long, idx long, x double, y double")
    boxes = spark.createDataFrame([(1, 7, 0.0, 0.0, 2.0, 2.0), (1, 8, 1.0, 1.0, 3.0, 3.0)], "pattern_id long, box long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.idx, r.box) for r in tables.contained(points, boxes, 0.7).collect()) == [(0, 7), (1, 8), (2, 7), (2, 8)]
    line = spark.createDataFrame([("s", k, float((k + 1) ** 2)) for k in range(6)], "s string, m int, i double")
    got = [r.intensity for r in tables.preprocessed_spectrum(line, 0, 9, "m", "i", "s").orderBy("m").collect()]
    assert got == pytest.approx([k / 21 for k in range(1, 7)])  # a line's roots stay what they are


def test_divergence_counts_cells_that_a_unit_lacks(spark):
    rows = [("u", "a")] * 3 + [("u", "b")] + [("v", "a")] * 2 + [("v", "c")] * 2
    got = {r.u: r.divergence for r in tables.unit_divergence(spark.createDataFrame(rows, "u string, s string"), "u", ["s"], 0.5).collect()}
    q = (np.array([5, 1, 2]) + 0.5) / 9.5
    for unit, k in (("u", [3, 1, 0]), ("v", [2, 0, 2])):
        p = (np.array(k) + 0.5) / 5.5
        assert got[unit] == pytest.approx((p * np.log2(p / q)).sum())


def test_gates_and_pooled_shares(spark):
    tests = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (2, "c", 0.02), (3, "d", 0.2)], "f int, t string, p double")
    assert {r.t: r.p_adjusted for r in groups.gatekept(tests, "f").collect()} == {"a": 0.01, "b": 0.04, "c": 0.04, "d": 0.2}
    units = spark.createDataFrame([("a", 7, 10), ("b", 3, 10), ("c", 1, 1), ("d", 0, 0)], "u string, k int, n int")
    got = {r.u: r for r in groups.beta_binomial_means(units, "u").collect()}
    assert set(got) == {"a", "b", "c"} and 0.3 < got["b"].pooled < 11 / 21 < got["c"].pooled < 1 and got["c"].weight < got["a"].weight


def test_simulated_clusters_have_the_expected_number_and_k(spark):
    pts = models.cluster_points(spark.range(40).withColumnRenamed("id", "pattern_id"), (0.0, 0.0, 100.0, 100.0), 0.004, 5.0, 3.0, 1)
    n = pts.groupBy("pattern_id").count().agg(F.avg("count")).first()[0]
    assert n == pytest.approx(0.004 * 5 * 1e4, rel=0.1)
    again = models.cluster_points(spark.range(40).withColumnRenamed("id", "pattern_id").repartition(7), (0.0, 0.0, 100.0, 100.0), 0.004, 5.0, 3.0, 1)
    assert again.exceptAll(pts).isEmpty()
    k = point_process.border_k(pts, [4.0], (0.0, 0.0, 100.0, 100.0)).agg(F.avg("k")).first()[0]
    assert k == pytest.approx(math.pi * 16 + (1 - math.exp(-16 / 36)) / 0.004, rel=0.2)


def test_unbalanced_transport_nears_the_balanced_one(spark):
    a, b = {1: 1.0, 2: 3.0}, {1: 2.0, 2: 2.0}
    costs = spark.createDataFrame([(0, s, t, a[s], b[t], float(s != t)) for s in a for t in b], "problem long, source long, target long, a double, b double, cost double")
    loose = {(r.source, r.target): r.mass for r in models.unbalanced_sinkhorn(costs, 0.5, 1e7, 3000).collect()}
    tight = {(r.source, r.target): r.mass * 4 for r in models.sinkhorn(costs, 0.5, 3000).collect()}
    assert loose == pytest.approx(tight, rel=1e-3)
    cheap = models.unbalanced_sinkhorn(costs.withColumn("cost", F.lit(50.0)), 0.5, 0.1, 500).agg(F.sum("mass")).first()[0]
    assert cheap < 1e-6  # far costs move nothing when missing mass is cheap
