"""Whole patterns in numpy against brute force and against Spark's own forms."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import draws, inside
from tessella.functions.core import envelope_bands
from tessella.operators import nulls
from tessella.plans import registry

#: Queries whose points are dealt by pattern once and never written as a row a point and shuffle.
WHOLE = [
    "assay_summary",
    "block_share_test",
    "repeated_permutation",
    "rejection_rates",
    "null_sensitivity",
    "marked_analysis",
    "analysis_report",
    "border_k_envelope",
    "close_pair_check",
    "cross_k_envelope",
    "mapper_nodes",
    "mapper_edges",
    "embedding_envelope",
    "anisotropy_null",
    "cross_interaction",
    "interference_test",
    "local_moran_max_t",
    "stratified_hotspots",
    "mark_covariance_envelope",
    "semivariogram_envelope",
    "motif_null",
    "spectral_null",
    "paired_analysis",
    "scan_permutation",
]


@pytest.mark.parametrize("name", WHOLE)
def test_points_are_dealt_once(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "Generate" not in plan


def test_constant_channel_summed_in_parts(spark):
    # two parts of 49 ones each: merged by 49 * (1 / 49), their variance isn't zero
    rows = spark.range(0, 5 * 98, numPartitions=2).select((F.col("id") % 5).alias("pattern_id"), F.col("id").alias("idx"), (F.col("id") % 97).cast("double").alias("x"), (F.col("id") % 89).cast("double").alias("y"), F.lit(1.0).alias("v"))
    got = nulls.assay_summary(rows, 30.0, ["v"], 20).groupBy("status").count().collect()
    assert [tuple(r) for r in got] == [("constant_channel", 5)]


def test_digests():
    tails = [f":{k * 7919**3}".encode() for k in range(300)] + [b"", b"x" * 40]
    heads = [f"{s}:{r}".encode() for s in (3, 131) for r in (1, 9, 10, 123)]
    for more in ([], [b"y" * 60]):  # more than a block goes one by one
        got = draws.digests(heads, tails + more)
        assert all(got[a, b].tobytes() == hashlib.md5(h + t).digest() for a, h in enumerate(heads) for b, t in enumerate(tails + more))


def test_orders_and_uniforms_by_digest():
    ids = sorted(k * 104729 % 999983 for k in range(150))
    keys = [[hashlib.md5(f"5:{r}:{i}".encode()).hexdigest() for i in ids] for r in range(1, 13)]
    assert draws.orders(ids, 5, 12).tolist() == [sorted(range(150), key=k.__getitem__) for k in keys]
    assert draws.orders(ids, 5, 3, first=4).tolist() == draws.orders(ids, 5, 12)[3:6].tolist()
    assert draws.uniforms(ids, 5, 12).tolist() == [[(int(d[:8], 16) + 0.5) / 4294967296.0 for d in k] for k in keys]
    groups = np.arange(150) % 3 - 1
    inner = draws.orders(ids, 5, 12, groups)
    for g in (0, 1):
        at = np.flatnonzero(groups == g)
        assert (inner[:, at] == at[draws.orders([ids[k] for k in at], 5, 12)]).all()
    assert (inner[:, groups < 0] == -1).all()


def test_near_is_every_pair_once(monkeypatch):
    rng = np.random.default_rng(3)
    x, y = np.round(rng.uniform(-40, 60, (2, 300)), 0)
    x[:4], y[:4], x[5] = 7.0, 7.0, np.nan
    group = rng.integers(0, 3, 300)
    for size in (64, 1 << 16):
        monkeypatch.setattr(inside, "BLOCK", size)
        for g in (None, group):
            got = sorted((min(i, j), max(i, j)) for a, b, _ in inside.near(x, y, 5.0, g) for i, j in zip(a.tolist(), b.tolist()))
            assert got == [(i, j) for i in range(300) for j in range(i + 1, 300) if (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= 25 and (g is None or g[i] == g[j])]
        near = [{j for j in range(300) if j != i and (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2 <= 25} for i in range(300)]
        three = sorted(tuple(sorted(t)) for b in inside.triangles(x, y, 5.0) for t in b.tolist())
        assert three == [(i, j, k) for i in range(300) for j in sorted(near[i]) if j > i for k in sorted(near[i] & near[j]) if k > j]
        first = list(range(300))
        while (to := [min([first[i], *(first[j] for j in near[i])]) for i in range(300)]) != first:
            first = to
        assert inside.linked(300, inside.near(x, y, 5.0)).tolist() == first
        marks = rng.integers(0, 5, (6, 300)).astype(float)
        assert np.allclose(inside.beside(marks, inside.near(x, y, 5.0)), [[sum(m[j] for j in near[i]) for i in range(300)] for m in marks])


@pytest.mark.parametrize("alpha", [0.05, 0.1, 0.3])
def test_envelope_as_by_spark(spark, alpha):
    curves = np.random.default_rng(int(alpha * 100)).integers(0, 6, (5, 20, 3)).astype(float)  # ties
    rows = spark.createDataFrame(pd.DataFrame([(f, r, b, v) for f, c in enumerate(curves) for r, row in enumerate(c) for b, v in enumerate(row)], columns=["family", "replicate", "bin", "value"]))
    want = envelope_bands(rows, ["family"], alpha).orderBy("family", "bin").toPandas()
    got = pd.concat([inside.band_rows(c, range(3), alpha, family=f) for f, c in enumerate(curves)], ignore_index=True)
    assert (got[want.columns].to_numpy(float) == want.to_numpy(float)).all()


def test_runs_of_shuffles_are_one_null(spark, monkeypatch):
    rows = spark.createDataFrame([(1, k, float(k * 37 % 50), float(k * 61 % 50), k % 3 == 0, float(k % 7)) for k in range(80)], "pattern_id long, idx long, x double, y double, mark boolean, value double").withColumn("mark", F.col("mark").cast("int"))
    once = nulls.scan_permutation(rows, 9.0, 39, 1).collect()
    x, ids = np.arange(80.0), np.arange(80)
    whole = np.concatenate(list(inside.shuffles(x, ids, 39, 1)))
    monkeypatch.setattr(inside, "ROWS", 7)
    parts = list(inside.shuffles(x, ids, 39, 1))
    assert len(once) == 1 and len(parts) == 6 and (np.concatenate(parts) == whole).all()
