"""Numerical models per independent unit, and spectra of patterns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import normal, poisson, uniform
from ..functions.seeds import splitmix64


def wave_numbers(spark, side: float, low: float, high: float) -> DataFrame:
    """Integer lattice of wave vectors with low <= |k| <= high, one of each opposite pair."""
    step, top = 2 * math.pi / side, math.ceil(high * side / (2 * math.pi))
    modes = [(a, b, step * a, step * b, math.hypot(step * a, step * b)) for a in range(0, top + 1) for b in range(-top, top + 1) if (a > 0 or b > 0)]
    return spark.createDataFrame([m for m in modes if low <= m[4] <= high], "mx int, my int, kx double, ky double, k double")


def structure_factor(points: DataFrame, modes: DataFrame, mark: str = "mark") -> DataFrame:
    """|sum (m - mean) exp(-ik.x)|^2 / n for each mode; the modes are a parameter table.

    Wave vectors lie on a lattice, so a point's phases are products of powers of two numbers, and a
    pattern's sums are one product of matrices a block of points.
    """
    held = modes.toPandas()  # by parameters
    mx, my, k = held["mx"].to_numpy(int), held["my"].to_numpy(int), held["k"].to_numpy(float)
    steps = [held[c].to_numpy(float)[at != 0][0] / at[at != 0][0] if (at != 0).any() else 0.0 for c, at in (("kx", mx), ("ky", my))]
    top = [int(np.abs(a).max(initial=0)) for a in (mx, my)]

    def powers(x: np.ndarray, step: float, most: int) -> np.ndarray:
        """exp(-i step x m) for m = -most .. most."""
        m = np.arange(most + 1)
        half = np.exp(-1j * step * x)[:, None] ** m
        return np.concatenate([half[:, :0:-1].conj(), half], axis=1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, total = pdf[mark].to_numpy(float), np.zeros((2 * top[0] + 1, 2 * top[1] + 1), complex)
        m = m - m.mean()
        for s in range(0, len(pdf), 65536):
            ex, ey = (powers(pdf[c].to_numpy(float)[s : s + 65536], d, t) for c, d, t in (("x", steps[0], top[0]), ("y", steps[1], top[1])))
            total += ex.T @ (m[s : s + 65536, None] * ey)
        power = np.abs(total[mx + top[0], my + top[1]]) ** 2 / len(pdf)
        return pd.DataFrame({"pattern_id": pdf["pattern_id"].iloc[0], "mx": mx, "my": my, "k": k, "power": power})

    return points.select("pattern_id", "x", "y", mark).groupBy("pattern_id").applyInPandas(run, "pattern_id long, mx int, my int, k double, power double")


def shell_means(powers: DataFrame, low: float, high: float, shells: int) -> DataFrame:
    """Mean power of each non-empty shell of equal width."""
    at = F.least(F.floor((F.col("k") - low) / ((high - low) / shells)), F.lit(shells - 1)).cast("int")
    return powers.groupBy("pattern_id", at.alias("shell")).agg(F.count(F.lit(1)).alias("modes"), F.avg("power").alias("power"))


def anisotropy(powers: DataFrame, side: float) -> DataFrame:
    """Eigenvalue ratio and axis of the power-weighted wave-vector tensor."""
    s = (2 * math.pi / side) ** 2
    t = powers.groupBy("pattern_id").agg(F.sum(F.col("power") * s * F.col("mx") * F.col("mx")).alias("xx"), F.sum(F.col("power") * s * F.col("mx") * F.col("my")).alias("xy"), F.sum(F.col("power") * s * F.col("my") * F.col("my")).alias("yy"))
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt((F.col("xx") - F.col("yy")) * (F.col("xx") - F.col("yy")) / 4 + F.col("xy") * F.col("xy"))
    return t.select("pattern_id", ((half + root) / F.nullif(half - root, F.lit(0.0))).alias("ratio"), (0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("axis"))


def kalman(series: DataFrame, transition: float, process: float, noise: float, mean: float, variance: float, key: str = "series", order: str = "t", value: str = "value") -> DataFrame:
    """Scalar filter and backward smoother of each series, in time order; a null observation only predicts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        n, seen = len(pdf), pdf[value].to_numpy(float)
        fm, fv, pm, pv, m, v, log = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), mean, variance, 0.0
        for k in range(n):
            if k:
                m, v = transition * m, transition * transition * v + process
            pm[k], pv[k] = m, v
            if seen[k] == seen[k]:
                s = v + noise
                gain = v / s
                log -= 0.5 * (math.log(2 * math.pi * s) + (seen[k] - m) ** 2 / s)
                m, v = m + gain * (seen[k] - m), (1 - gain) * v
            fm[k], fv[k] = m, v
        sm, sv = fm.copy(), fv.copy()
        for k in range(n - 2, -1, -1):
            g = fv[k] * transition / pv[k + 1]
            sm[k] += g * (sm[k + 1] - pm[k + 1])
            sv[k] += g * g * (sv[k + 1] - pv[k + 1])
        return pd.DataFrame({key: pdf[key], order: pdf[order], "filtered": fm, "smoothed": sm, "smoothed_variance": sv, "log_likelihood": log})

    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    return series.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, filtered double, smoothed double, smoothed_variance double, log_likelihood double")


def sinkhorn(costs: DataFrame, epsilon: float, rounds: int, tolerance: float = 1e-9) -> DataFrame:
    """Entropic transport of each problem: costs(problem, source, target, a, b, cost) -> plan mass."""

    def soft(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "target"])
        c = pdf.pivot(index="source", columns="target", values="cost")
        a, b = pdf.groupby("source")["a"].first().to_numpy(float), pdf.groupby("target")["b"].first().to_numpy(float)
        k, f, g = -c.to_numpy(float) / epsilon, np.zeros(len(a)), np.zeros(len(b))
        la, lb = np.log(a / a.sum()), np.log(b / b.sum())
        for _ in range(rounds):
            f = la - soft(k + g[None], 1)
            new = lb - soft(k + f[:, None], 0)
            done, g = np.abs(new - g).max() < tolerance, new
            if done:
                break
        plan = np.exp(k + f[:, None] + g[None])
        return pd.DataFrame({"problem": pdf["problem"].iloc[0], "source": np.repeat(c.index.to_numpy(), len(b)), "target": np.tile(c.columns.to_numpy(), len(a)), "mass": plan.reshape(-1)})

    return costs.groupBy("problem").applyInPandas(run, "problem long, source long, target long, mass double")


def uniform_points(patterns: DataFrame, window: tuple[float, float, float, float], seed: int) -> DataFrame:
    """n points uniform in a rectangle for each pattern(pattern_id, n), drawn by pattern and index."""
    x0, y0, x1, y1 = window
    rows = patterns.where("n > 0").select("pattern_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("idx"))
    return rows.select("pattern_id", "idx", (x0 + (x1 - x0) * uniform(seed, "pattern_id", "idx")).alias("x"), (y0 + (y1 - y0) * uniform(seed + 1, "pattern_id", "idx")).alias("y"))


def beta_posterior(points: DataFrame, a: float, b: float, *by: str) -> DataFrame:
    """Mean and variance of the Beta posterior of a group's marked share."""
    s = points.groupBy(*by).agg(F.sum("mark").alias("m"), F.count(F.lit(1)).alias("n"))
    al, be = F.col("m") + a, F.col("n") - F.col("m") + b
    return s.select(*by, "n", (al / (al + be)).alias("mean"), (al * be / ((al + be) * (al + be) * (al + be + 1))).alias("variance"))


def cluster_points(patterns: DataFrame, window: tuple[float, float, float, float], density: float, offspring: float, scale: float, seed: int, disc: bool = False) -> DataFrame:
    """Cluster patterns: Poisson parents, each with Poisson offspring, normal or uniform in a disc.

    patterns(pattern_id); parents come from the window widened by four scales (one for discs), and
    offspring outside the window are not part of the pattern. Every number depends on the pattern,
    its parent and child alone.
    """
    x0, y0, x1, y1 = window
    wide = scale if disc else 4 * scale
    wx, wy = x1 - x0 + 2 * wide, y1 - y0 + 2 * wide
    own, up, child = ("pattern_id",), ("pattern_id", "parent"), ("pattern_id", "parent", "child")
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    rows = patterns.select("pattern_id", poisson(density * wx * wy, seed, *own).alias("n")).where("n > 0").select("pattern_id", upto(F.col("n")).alias("parent"))
    rows = rows.withColumn("n", poisson(offspring, seed + 1, *up)).where("n > 0").withColumn("child", upto(F.col("n")))
    if disc:
        far, turn = scale * F.sqrt(uniform(seed + 4, *child)), 2 * F.pi() * uniform(seed + 5, *child)
        dx, dy = far * F.cos(turn), far * F.sin(turn)
    else:
        dx, dy = scale * normal(seed + 4, *child), scale * normal(seed + 6, *child)
    x, y = x0 - wide + wx * uniform(seed + 2, *up) + dx, y0 - wide + wy * uniform(seed + 3, *up) + dy
    out = rows.select("pattern_id", (F.col("parent").cast("long") * 1048576 + F.col("child")).alias("idx"), x.alias("x"), y.alias("y"))
    return out.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))


def unbalanced_sinkhorn(costs: DataFrame, epsilon: float, rho: float, rounds: int, tolerance: float = 1e-9) -> DataFrame:
    """Entropic transport whose marginals may miss their masses at a price of rho times the divergence."""

    def soft(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.pivot(index="source", columns="target", values="cost")
        la, lb = (np.log(pdf.groupby(n)[m].first().to_numpy(float)) for n, m in (("source", "a"), ("target", "b")))
        k, f, g, give = -c.to_numpy(float) / epsilon, np.zeros(len(la)), np.zeros(len(lb)), rho / (rho + epsilon)
        for _ in range(rounds):
            f = give * (la - soft(k + g[None], 1))
            new = give * (lb - soft(k + f[:, None], 0))
            done, g = np.abs(new - g).max() < tolerance, new
            if done:
                break
        plan = np.exp(k + f[:, None] + g[None])
        return pd.DataFrame({"problem": pdf["problem"].iloc[0], "source": np.repeat(c.index.to_numpy(), len(lb)), "target": np.tile(c.columns.to_numpy(), len(la)), "mass": plan.reshape(-1)})

    return costs.groupBy("problem").applyInPandas(run, "problem long, source long, target long, mass double")
