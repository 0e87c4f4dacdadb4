"""Diffusion on graphs, growth and competition models, particle filters and rejection fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import pairs
from ..functions.lineage import cut


def _bessel(k: int, t: float) -> float:
    """Modified Bessel function of the first kind, by its series."""
    return sum((t / 2) ** (2 * m + k) / (math.factorial(m) * math.factorial(m + k)) for m in range(40))


def chebyshev_heat(points: DataFrame, radius: float, time: float, degree: int, value: str = "value") -> DataFrame:
    """exp(-time * L) applied to a signal on the radius graph, L the normalised Laplacian.

    The operator's spectrum lies in [0, 2], so Chebyshev polynomials of L - 1 need no estimate of
    it. Each degree is one join of the signal with the edges; isolated nodes decay by e^-time.
    """
    edges = pairs(points, None, radius).select("pattern_id", "i", "j")
    degree_of = edges.groupBy("pattern_id", "i").agg(F.count(F.lit(1)).alias("deg"))
    other = degree_of.select("pattern_id", F.col("i").alias("j"), F.col("deg").alias("jdeg"))
    weights = cut(edges.join(degree_of, ["pattern_id", "i"]).join(other, ["pattern_id", "j"]).select("pattern_id", "i", F.col("j").alias("idx"), (-1 / F.sqrt(F.col("deg") * F.col("jdeg"))).alias("w")))
    coefficients = [(1 if k == 0 else 2) * (-1) ** k * _bessel(k, time) * math.exp(-time) for k in range(degree + 1)]
    state = points.select("pattern_id", "idx", F.col(value).cast("double").alias("new"), F.lit(0.0).alias("old"), (F.col(value) * coefficients[0]).alias("heat"))
    for k in range(1, degree + 1):
        moved = state.select("pattern_id", "idx", "new").join(weights, ["pattern_id", "idx"]).groupBy("pattern_id", F.col("i").alias("idx")).agg(F.sum(F.col("w") * F.col("new")).alias("m"))
        step = F.coalesce("m", F.lit(0.0)) if k == 1 else 2 * F.coalesce("m", F.lit(0.0)) - F.col("old")
        state = state.join(moved, ["pattern_id", "idx"], "left").withColumn("next", step)
        state = cut(state.select("pattern_id", "idx", F.col("next").alias("new"), F.col("new").alias("old"), (F.col("heat") + coefficients[k] * F.col("next")).alias("heat")))
    return state.select("pattern_id", "idx", "heat")


def growth_front(scenarios: DataFrame, cells: int, width: float, step: float, steps: int) -> DataFrame:
    """Explicit Fisher-KPP runs on a line: scenarios(key, rate, diffusion) -> front place and total.

    The left end starts at one; ends reflect. The front is the last cell at or above one half. A
    step beyond the scheme's limit width^2 / (2 * diffusion) raises ValueError.
    """

    def run(it):
        for pdf in it:
            out = []
            for key, rate, diffusion in zip(pdf["key"], pdf["rate"], pdf["diffusion"]):
                if step * diffusion > width * width / 2:
                    raise ValueError("the time step is too long for this diffusion")
                u = np.zeros(cells)
                u[0] = 1.0
                for _ in range(steps):
                    padded = np.concatenate([u[:1], u, u[-1:]])
                    u = u + step * (diffusion * (padded[2:] - 2 * u + padded[:-2]) / width**2 + rate * u * (1 - u))
                above = np.flatnonzero(u >= 0.5)
                out.append((key, float(above[-1] * width) if len(above) else 0.0, float(u.sum() * width)))
            yield pd.DataFrame(out, columns=["key", "front", "total"])

    return scenarios.select(F.col("key").cast("long"), F.col("rate").cast("double"), F.col("diffusion").cast("double")).mapInPandas(run, "key long, front double, total double")


def competition(scenarios: DataFrame, step: float, steps: int) -> DataFrame:
    """Two competitors by fourth-order steps: scenarios(key, a, b, x, y) -> their sizes at the end.

    x' = x (1 - x - a y), y' = y (1 - y - b x).
    """

    def run(it):
        for pdf in it:
            a, b = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
            s = np.stack([pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)])
            f = lambda s: np.stack([s[0] * (1 - s[0] - a * s[1]), s[1] * (1 - s[1] - b * s[0])])  # noqa: B023, E731
            for _ in range(steps):
                k1 = f(s)
                k2 = f(s + step / 2 * k1)
                k3 = f(s + step / 2 * k2)
                s = s + step / 6 * (k1 + 2 * k2 + 2 * k3 + f(s + step * k3))
            yield pd.DataFrame({"key": pdf["key"], "x": s[0], "y": s[1]})

    return scenarios.select(F.col("key").cast("long"), *[F.col(c).cast("double") for c in ("a", "b", "x", "y")]).mapInPandas(run, "key long, x double, y double")


def particle_filter(series: DataFrame, transition: float, process: float, noise: float, mean: float, variance: float, particles: int, seed: int, least: float = 0.5) -> DataFrame:
    """Bootstrap filter of series(series, t, value): filtered mean, effective sample size, log likelihood.

    Particles are resampled systematically when their effective number falls below `least` of them.
    Null values are missing and only move the particles. A series is the unit of work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        rng = np.random.default_rng([seed, int(pdf["series"].iloc[0]) & 0xFFFFFFFF])
        x, w, total, out = rng.normal(mean, math.sqrt(variance), particles), np.full(particles, 1 / particles), 0.0, []
        for n, (t, v) in enumerate(zip(pdf["t"], pdf["value"])):
            if n:
                x = transition * x + rng.normal(0, math.sqrt(process), particles)
            if v == v and v is not None:
                logs = np.log(w) - (v - x) ** 2 / (2 * noise) - math.log(2 * math.pi * noise) / 2
                top = logs.max()
                w = np.exp(logs - top)
                total += top + math.log(w.sum())
                w = np.maximum(w / w.sum(), 1e-300)
            size = 1 / (w * w).sum()
            out.append((pdf["series"].iloc[0], t, float((w * x).sum() / w.sum()), size, total))
            if size < least * particles:
                at = np.searchsorted(np.cumsum(w) / w.sum(), (rng.uniform() + np.arange(particles)) / particles)
                x, w = x[np.minimum(at, particles - 1)], np.full(particles, 1 / particles)
        return pd.DataFrame(out, columns=["series", "t", "mean", "effective", "log_likelihood"])

    return series.groupBy("series").applyInPandas(run, "series long, t long, mean double, effective double, log_likelihood double")


def rejection_growth(curves: DataFrame, low: float, high: float, draws: int, tolerance: float) -> DataFrame:
    """Growth rates by rejection: curves(key, t, value) against exp(rate * t), rates spread evenly over a prior.

    Draws follow the golden-ratio sequence in [low, high). A draw is accepted if its root mean
    square distance to log(value) is within tolerance. -> key, accepted, mean, least, most; a key
    that accepts none has nulls. The prior is parameters only, and curves meet it by aggregates.
    """
    t, v = F.col("t"), F.log("value")
    moments = curves.where("value > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(t * t).alias("tt"), F.sum(t * v).alias("tv"), F.sum(v * v).alias("vv"))
    rates = F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda x: F.lit(low) + (high - low) * (x * F.lit(0.6180339887498949) - F.floor(x * F.lit(0.6180339887498949))))
    each = moments.select("*", F.explode(rates).alias("rate"))
    far = F.sqrt(F.greatest(F.lit(0.0), F.col("rate") * F.col("rate") * F.col("tt") - 2 * F.col("rate") * F.col("tv") + F.col("vv")) / F.col("n"))
    kept = F.when(far <= tolerance, F.col("rate"))
    return each.groupBy("key").agg(F.count(kept).alias("accepted"), F.avg(kept).alias("mean"), F.min(kept).alias("least"), F.max(kept).alias("most"))
