"""Small fits and filters: logistic models over folds, variance shares, Laplace approximations, a nonlinear
filter, and explicit solvers on a line."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import cut


def logistic_folds(rows: DataFrame, by: str, item: str, fold: Column, folds: int, x: str, label: str, ridge: float, rounds: int = 10) -> DataFrame:
    """Out-of-fold probabilities of a penalised logistic line: by, item, fold, label, p.

    Each fold's model is fitted on the other folds by Newton steps from zero; the slope alone is
    penalised. A step needs five sums a model, so no fold is gathered anywhere.
    """
    own = cut(rows.select(by, item, fold.cast("int").alias("fold"), F.col(x).cast("double").alias("x"), F.col(label).cast("double").alias("y")))
    models = F.broadcast(rows.sparkSession.range(folds).select(F.col("id").cast("int").alias("model")))  # by a parameter
    train = own.join(models, F.col("fold") != F.col("model"))
    fit = own.select(by).distinct().crossJoin(models).withColumns({"a": F.lit(0.0), "b": F.lit(0.0)})
    for _ in range(rounds):
        m = train.join(fit, [by, "model"]).withColumn("p", 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x")))))
        w, r = F.col("p") * (1 - F.col("p")), F.col("y") - F.col("p")
        s = m.groupBy(by, "model").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum(r).alias("g0"), F.sum(r * F.col("x")).alias("g1"), F.sum(w).alias("h0"), F.sum(w * F.col("x")).alias("h1"), F.sum(w * F.col("x") * F.col("x")).alias("h2"))
        s = s.withColumn("g1", F.col("g1") - ridge * F.col("b")).withColumn("h2", F.col("h2") + ridge)
        det = F.col("h0") * F.col("h2") - F.col("h1") * F.col("h1")
        fit = cut(s.select(by, "model", (F.col("a") + (F.col("h2") * F.col("g0") - F.col("h1") * F.col("g1")) / det).alias("a"), (F.col("b") + (F.col("h0") * F.col("g1") - F.col("h1") * F.col("g0")) / det).alias("b")))
    out = own.join(fit.withColumnRenamed("model", "fold"), [by, "fold"])
    return out.select(by, item, "fold", F.col("y").cast("int").alias("label"), (1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))).alias("p"))


def conformal_sets(scores: DataFrame, by: str, alpha: float) -> DataFrame:
    """Class-conditional cross-conformal prediction of scored rows(by, item, fold, label, p): whether each
    class is kept, by its rank among the other folds' rows of that class -> by, label, rows, covered,
    mean_size."""
    s = scores.withColumn("c", F.when(F.col("label") == 1, 1 - F.col("p")).otherwise(F.col("p")))  # how odd its own class is
    cal = s.groupBy(by, "label", "fold", F.round("c", 6).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    each = scores.select(by, "item", "fold", "label", F.explode(F.array(*[F.struct(F.lit(v).alias("cls"), F.round(o, 6).alias("odd")) for v, o in ((1, 1 - F.col("p")), (0, F.col("p")))])).alias("e")).select(by, "item", "fold", "label", "e.*")
    size = cal.groupBy(by, "label", "fold").agg(F.sum("k").alias("k"))
    total = size.groupBy(by, F.col("label").alias("cls")).agg(F.sum("k").alias("total"))
    left = total.join(size.select(by, F.col("label").alias("cls"), "fold", "k"), [by, "cls"]).select(by, "cls", "fold", (F.col("total") - F.col("k")).alias("n"))
    # rows at least as odd: counted over distinct oddness, in order
    down = Window.partitionBy(by, "label").orderBy(F.desc("c")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = cal.groupBy(by, "label", "c").agg(F.sum("k").alias("k")).withColumn("all", F.sum("k").over(down))
    own = Window.partitionBy(by, "label", "fold").orderBy(F.desc("c")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    held = cal.withColumn("own", F.sum("k").over(own))
    pts = each.select(by, "cls", "fold", F.col("odd").alias("c")).distinct()
    a = pts.join(run.select(by, F.col("label").alias("cls"), F.col("c").alias("rc"), "all"), [by, "cls"]).where("rc >= c").groupBy(by, "cls", "fold", "c").agg(F.max("all").alias("all"))
    b = pts.join(held.select(by, F.col("label").alias("cls"), "fold", F.col("c").alias("rc"), "own"), [by, "cls", "fold"]).where("rc >= c").groupBy(by, "cls", "fold", "c").agg(F.max("own").alias("own"))
    p = pts.join(a, [by, "cls", "fold", "c"], "left").join(b, [by, "cls", "fold", "c"], "left").join(left, [by, "cls", "fold"], "left")
    p = p.select(by, "cls", "fold", F.col("c").alias("odd"), ((1 + F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0))) / (1 + F.coalesce("n", F.lit(0)))).alias("value"))
    kept = each.join(p, [by, "cls", "fold", "odd"]).withColumn("kept", F.col("value") > alpha)
    rows = kept.groupBy(by, "item", "label").agg(F.sum(F.col("kept").cast("int")).alias("size"), F.max((F.col("kept") & (F.col("cls") == F.col("label"))).cast("int")).alias("hit"))
    return rows.groupBy(by, "label").agg(F.count(F.lit(1)).alias("rows"), F.avg("hit").alias("covered"), F.avg("size").alias("mean_size"))


def variance_shares(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Variance of a nested design by moments: between outer units, between inner ones and within ->
    outer, inner, within (shares of their sum, none below zero)."""
    cells = rows.groupBy(outer, inner).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("n > 0")
    within = F.sum(F.when(F.col("n") > 1, (F.col("n") - 1) * F.col("v"))) / F.sum(F.when(F.col("n") > 1, F.col("n") - 1))
    w = cells.agg(within.alias("w"))
    up = cells.groupBy(outer).agg(F.count(F.lit(1)).alias("k"), F.avg("m").alias("mm"), F.var_samp("m").alias("vm"), F.avg(1 / F.col("n")).alias("inv"))
    s = up.crossJoin(w).agg(F.first("w").alias("w"), F.avg(F.when(F.col("k") > 1, F.col("vm") - F.col("w") * F.col("inv"))).alias("i"), F.var_samp("mm").alias("vo"), F.avg((F.col("w") * F.col("inv")) / F.col("k")).alias("wi"), F.avg(1 / F.col("k")).alias("ik"))
    inner_, zero = F.greatest(F.lit(0.0), F.coalesce("i", F.lit(0.0))), F.lit(0.0)
    outer_ = F.greatest(zero, F.coalesce(F.col("vo"), zero) - inner_ * F.col("ik") - F.col("wi"))
    total = inner_ + outer_ + F.col("w")
    return s.select((outer_ / total).alias("outer"), (inner_ / total).alias("inner"), (F.col("w") / total).alias("within"))


def laplace_share(counts: DataFrame, by: str, marked: str, n: str, spread: float, rounds: int = 8) -> DataFrame:
    """Log odds of a unit's share under a normal prior around zero: mode by Newton steps, its deviation
    from the curvature, and the log evidence to second order (but for the binomial coefficient)."""
    out, k, t = counts.select(by, F.col(marked).cast("double").alias("k"), F.col(n).cast("double").alias("n")).withColumn("x", F.lit(0.0)), F.col("k"), 1 / (spread * spread)
    p = 1 / (1 + F.exp(-F.col("x")))
    h = F.col("n") * p * (1 - p) + t
    for _ in range(rounds):
        out = out.withColumn("x", F.col("x") + (k - F.col("n") * p - t * F.col("x")) / h)
    evidence = k * F.col("x") - F.col("n") * F.log1p(F.exp(F.col("x"))) - t * F.col("x") * F.col("x") / 2 + 0.5 * F.log(t / h)
    return out.select(by, F.col("x").alias("mode"), (1 / F.sqrt(h)).alias("deviation"), evidence.alias("log_evidence"))


def extended_filter(series: DataFrame, gain: float, process: float, noise: float, mean: float, variance: float, key: str = "series", order: str = "t", value: str = "value") -> DataFrame:
    """Extended Kalman filter of x' = x + gain sin(x), seen as x + x^2 / 20, each with Gaussian noise ->
    key, order, filtered, variance."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, m, v, out = pdf.sort_values(order), mean, variance, []
        for k, y in enumerate(pdf[value].to_numpy(float)):
            if k:
                slope = 1 + gain * math.cos(m)
                m, v = m + gain * math.sin(m), slope * slope * v + process
            if y == y:
                h = 1 + m / 10
                g = v * h / (h * h * v + noise)
                m, v = m + g * (y - m - m * m / 20), (1 - g * h) * v
            out.append((m, v))
        fm, fv = np.array(out).reshape(-1, 2).T
        return pd.DataFrame({key: pdf[key], order: pdf[order], "filtered": fm, "variance": fv})

    kinds = {f.name: f.dataType.simpleString() for f in series.schema.fields}
    return series.select(key, order, value).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, filtered double, variance double")


def ring_fields(scenarios: DataFrame, cells: int, step: float, steps: int) -> DataFrame:
    """Explicit runs on a ring of cells from a few raised ones: scenarios(key, kind, a, b, diffusion) ->
    key, kind, mean, spread, top of the field at the end.

    `phase`: u' = D u'' + a (u - u^3) + b; `carried`: u' = D u'' - a u_x (upwind) + b (1 - u);
    `pattern`: two fields, feed a and kill b, the first one spreading twice as fast as the second.
    """

    def run(it):
        for pdf in it:
            out = []
            for key, kind, a, b, d in zip(pdf["key"], pdf["kind"], pdf["a"], pdf["b"], pdf["diffusion"]):
                if 2 * d * step > 1 or kind == "carried" and a * step > 1:
                    raise ValueError("the time step is too long")
                at = np.arange(cells)
                raised = (at >= cells // 4) & (at < cells // 2)
                u = np.where(raised, 0.5, 1.0) if kind == "pattern" else np.where(raised, 0.8, -0.2 if kind == "phase" else 0.0)
                v = np.where(raised, 0.25, 0.0)
                bend = lambda f: np.roll(f, 1) - 2 * f + np.roll(f, -1)
                for _ in range(steps):
                    if kind == "phase":
                        u = u + step * (d * bend(u) + a * (u - u * u * u) + b)
                    elif kind == "carried":
                        u = u + step * (d * bend(u) - a * (u - np.roll(u, 1)) + b * (1 - u))
                    else:
                        uvv = u * v * v
                        u, v = u + step * (d * bend(u) - uvv + a * (1 - u)), v + step * (d / 2 * bend(v) + uvv - (a + b) * v)
                out.append((key, kind, u.mean(), u.std(), u.max()))
            yield pd.DataFrame(out, columns=["key", "kind", "mean", "spread", "top"])

    rows = scenarios.select(F.col("key").cast("long"), "kind", *[F.col(c).cast("double") for c in ("a", "b", "diffusion")])
    return rows.mapInPandas(run, "key long, kind string, mean double, spread double, top double")
