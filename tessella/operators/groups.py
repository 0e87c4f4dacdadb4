"""Group comparisons, posteriors in closed form, calibration and sensitivity from sufficient statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def energy_distance(rows: DataFrame, key: str) -> DataFrame:
    """Energy distance of `value` between two groups (is_first), all pairs of a group with itself included.

    In one dimension it is twice the integral of the squared difference of the distribution
    functions, so a running sum over distinct values replaces all pairs.
    """
    at = rows.groupBy(key, "value").agg(F.count(F.when(F.col("is_first"), 1)).alias("a"), F.count(F.when(~F.col("is_first"), 1)).alias("b"))
    n = at.groupBy(key).agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second")).where("n_first > 0 and n_second > 0")
    up = Window.partitionBy(key).orderBy("value")
    so_far = up.rowsBetween(Window.unboundedPreceding, 0)
    run = at.join(n, key).select(key, "n_first", "n_second", (F.lead("value").over(up) - F.col("value")).alias("gap"), (F.sum("a").over(so_far) / F.col("n_first") - F.sum("b").over(so_far) / F.col("n_second")).alias("d"))
    return run.groupBy(key).agg(F.max("n_first").alias("n_first"), F.max("n_second").alias("n_second"), (2 * F.sum(F.col("gap") * F.col("d") * F.col("d"))).alias("energy"))


def linear_mmd(vectors: DataFrame, key: str, vector: str, reference) -> DataFrame:
    """Squared mean discrepancy, with a linear kernel, between each group and a reference group.

    biased keeps the kernel's diagonal: the squared distance of the means. unbiased drops it, which
    takes only each group's size, sum and sum of squared norms; null for groups of one.
    """
    v = F.col("v").cast("double")
    tall = vectors.select(key, F.posexplode(vector).alias("pos", "v")).groupBy(key, "pos").agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    ref = tall.where(F.col(key) == reference).select("pos", F.col("n").alias("rn"), F.col("s").alias("rs"), F.col("q").alias("rq"))
    both = tall.where(F.col(key) != reference).join(F.broadcast(ref), "pos")
    gap = F.col("s") / F.col("n") - F.col("rs") / F.col("rn")
    own = lambda s, q, n: (F.col(s) * F.col(s) - F.col(q)) / F.nullif(F.col(n) * (F.col(n) - 1), F.lit(0))
    unbiased = own("s", "q", "n") + own("rs", "rq", "rn") - 2 * F.col("s") * F.col("rs") / (F.col("n") * F.col("rn"))
    return both.groupBy(key).agg(F.max("n").alias("n"), F.sum(gap * gap).alias("biased"), F.sum(unbiased).alias("unbiased"))


def leave_one_out(effects: DataFrame, key: str, effect: str = "difference") -> DataFrame:
    """Inverse-variance pooled effect and standard error without each unit; null for a single unit."""
    w = effects.where("standard_error > 0").withColumn("w", 1 / (F.col("standard_error") * F.col("standard_error"))).withColumn("wx", F.col("w") * F.col(effect))
    total = w.agg(F.sum("w").alias("tw"), F.sum("wx").alias("twx"), F.count(F.lit(1)).alias("units"))
    left = F.when(F.col("units") > 1, F.col("tw") - F.col("w"))
    return w.join(F.broadcast(total)).select(key, ((F.col("twx") - F.col("wx")) / left).alias("pooled"), (1 / F.sqrt(left)).alias("standard_error"))


def fingerprint_distance(features: DataFrame, key: str, columns: Sequence[str], reference) -> DataFrame:
    """Euclidean distance of each unit's standardised features from a reference unit's.

    Features are scaled by their sample deviation over units; one that doesn't vary is left out.
    """
    scale = features.agg(*[F.stddev_samp(c).alias(f"sd_{c}") for c in columns])
    ref = features.where(F.col(key) == reference).select(*[F.col(c).alias(f"ref_{c}") for c in columns])
    gap = lambda c: F.coalesce((F.col(c) - F.col(f"ref_{c}")) / F.nullif(F.col(f"sd_{c}"), F.lit(0.0)), F.lit(0.0))
    out = features.join(F.broadcast(scale)).join(F.broadcast(ref))
    return out.select(key, F.sqrt(sum((gap(c) * gap(c) for c in columns), F.lit(0.0))).alias("distance"))


def stratified_aipw(rows: DataFrame, key: str, stratum: str, treated: str, outcome: str) -> DataFrame:
    """Augmented inverse-propensity effect with both nuisance models saturated in the strata.

    Influence values are summed per stratum from its moments. Strata without both arms have no
    support and are left out; n counts what stays.
    """
    arm = lambda f, t: f(F.when(F.col(treated) == t, F.col(outcome)))
    s = rows.groupBy(key, stratum).agg(arm(F.count, 1).alias("n1"), arm(F.count, 0).alias("n0"), arm(F.avg, 1).alias("m1"), arm(F.avg, 0).alias("m0"), arm(F.var_pop, 1).alias("v1"), arm(F.var_pop, 0).alias("v0"))
    s = s.where("n1 > 0 and n0 > 0").withColumn("n", F.col("n1") + F.col("n0")).withColumn("t", F.col("m1") - F.col("m0")).withColumn("e", F.col("n1") / F.col("n"))
    noise = F.col("n1") * F.col("v1") / (F.col("e") * F.col("e")) + F.col("n0") * F.col("v0") / ((1 - F.col("e")) * (1 - F.col("e")))
    a = s.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("t")).alias("nt"), F.sum(F.col("n") * F.col("t") * F.col("t")).alias("ntt"), F.sum(noise).alias("noise"))
    effect = F.col("nt") / F.col("n")
    return a.select(key, "n", effect.alias("effect"), (F.sqrt(F.col("ntt") - F.col("n") * effect * effect + F.col("noise")) / F.col("n")).alias("standard_error"))


def sign_sensitivity(rows: DataFrame, key: str, difference: Column, gammas: Sequence[float]) -> DataFrame:
    """Sign test under hidden bias: the least and the greatest normal deviate for each bias gamma."""
    n, up = F.count(F.when(difference != 0, 1)), F.count(F.when(difference > 0, 1))
    each = F.explode(F.array(*[F.lit(float(g)) for g in gammas])).alias("gamma")
    at = rows.groupBy(key).agg(n.alias("n"), up.alias("up")).where("n > 0").select(key, "n", "up", each)
    z = lambda p: (F.col("up") - F.col("n") * p) / F.sqrt(F.col("n") * p * (1 - p))
    high = F.col("gamma") / (1 + F.col("gamma"))
    return at.select(key, "gamma", "n", "up", z(high).alias("z_low"), z(1 - high).alias("z_high"))


def normal_posterior(rows: DataFrame, key: str, value: str, prior_mean: float, prior_variance: float, noise_variance: float) -> DataFrame:
    """Conjugate posterior of a mean with known noise, and the information gained (nats)."""
    a = rows.groupBy(key).agg(F.count(value).alias("n"), F.sum(value).alias("s"))
    precision = 1 / F.lit(float(prior_variance)) + F.col("n") / float(noise_variance)
    mean = (prior_mean / prior_variance + F.coalesce("s", F.lit(0.0)) / float(noise_variance)) / precision
    return a.select(key, "n", mean.alias("mean"), (1 / precision).alias("variance"), (F.log(precision * float(prior_variance)) / 2).alias("information"))


def dirichlet_posterior(rows: DataFrame, key: str, label: str, alpha: float, classes: Sequence[str]) -> DataFrame:
    """Posterior mean and variance of each class share; classes that a unit lacks are there too."""
    n = rows.where(F.col(label).isin(list(classes))).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.count(F.when(F.col(label) == c, 1)).alias(f"k{i}") for i, c in enumerate(classes)])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"k{i}").alias("k")) for i, c in enumerate(classes)])).alias("v")
    total = F.col("n") + float(alpha) * len(classes)
    mean = (F.col("v.k") + float(alpha)) / total
    return n.select(key, "n", each).select(key, F.col("v.class").alias("class"), F.col("v.k").alias("count"), mean.alias("mean"), (mean * (1 - mean) / (total + 1)).alias("variance"))


def conformal_quantiles(scores: DataFrame, key: str, score: str, alpha: float) -> DataFrame:
    """The ceil((n + 1)(1 - alpha))-th smallest score of each group; null if the group is too small."""
    at = scores.groupBy(key, score).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(key).orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    run = at.withColumn("upto", F.sum("k").over(w))
    n = at.groupBy(key).agg(F.sum("k").alias("n")).withColumn("rank", F.ceil((F.col("n") + 1) * (1 - alpha) - 1e-9))
    return run.join(n, key).groupBy(key, "n", "rank").agg(F.min(F.when(F.col("upto") >= F.col("rank"), F.col(score))).alias("quantile"))


def abstention(scores: DataFrame, key: str, thresholds: Sequence[float], score: str = "score", label: str = "label") -> DataFrame:
    """Coverage and error of what is decided when scores too near one half abstain."""
    sure = F.greatest(F.col(score), 1 - F.col(score))
    wrong = (F.col(score) >= 0.5).cast("int") != F.col(label)
    each = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    out = scores.select(key, sure.alias("sure"), wrong.alias("wrong"), each).groupBy(key, "threshold").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("sure") >= F.col("threshold"), 1)).alias("decided"), F.count(F.when((F.col("sure") >= F.col("threshold")) & F.col("wrong"), 1)).alias("wrong"))
    return out.select(key, "threshold", (F.col("decided") / F.col("n")).alias("coverage"), (F.col("wrong") / F.nullif("decided", F.lit(0))).alias("error"))


def log_score_weights(scores: DataFrame, key: str, first: str, second: str, label: str, steps: int = 10, least: float = 1e-6) -> DataFrame:
    """Mixtures of two predictions over a lattice of weights: mean log score, and the first best weight."""
    each = F.explode(F.array(*[F.lit(k / steps) for k in range(steps + 1)])).alias("weight")
    p = F.col("weight") * F.col(first) + (1 - F.col("weight")) * F.col(second)
    hit = F.log(F.greatest(F.when(F.col(label) == 1, p).otherwise(1 - p), F.lit(float(least))))
    at = scores.select(key, first, second, label, each).groupBy(key, "weight").agg(F.avg(hit).alias("log_score"))
    best = at.groupBy(key).agg(F.max(F.struct(F.round("log_score", 9).alias("s"), F.negative("weight").alias("o"))).alias("b"))
    return at.join(best, key).select(key, "weight", "log_score", (F.col("weight") == -F.col("b.o")).alias("selected"))


def beta_binomial_means(counts: DataFrame, key: str, successes: str = "k", trials: str = "n") -> DataFrame:
    """Partially pooled shares: a beta prior by moments of the units' shares, then each unit's posterior mean.

    The moments weigh units by their trials; without extra spread the prior is a point and every
    unit has the pooled share. Units without trials are left out.
    """
    n, k = F.col(trials).cast("double"), F.col(successes).cast("double")
    u = counts.where(F.col(trials) > 0).select(key, n.alias("n"), k.alias("k"))
    a = u.agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("nn"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum("k").alias("kk"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk2"))
    share = F.col("kk") / F.col("nn")
    spread = F.col("kk2") - F.col("nn") * share * share
    unit = share * (1 - share)
    # intraclass correlation by the analysis-of-variance moments
    rho = (spread - unit * (F.col("m") - 1)) / F.nullif(unit * (F.col("nn") - F.col("n2") / F.col("nn") - (F.col("m") - 1)), F.lit(0.0))
    a = a.select(share.alias("all"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(rho, F.lit(0.0)))).alias("rho"))
    w = F.col("n") * F.col("rho") / (1 + (F.col("n") - 1) * F.col("rho"))
    return u.join(F.broadcast(a)).select(key, F.col("n").cast("long").alias("trials"), (F.col("k") / F.col("n")).alias("share"), w.alias("weight"), (F.col("all") + w * (F.col("k") / F.col("n") - F.col("all"))).alias("pooled"))


def gatekept(tests: DataFrame, family: str, p: str = "p") -> DataFrame:
    """Serial gatekeeping: a test's p is at least the largest p of every earlier family.

    The window runs over families, one row each.
    """
    top = tests.groupBy(family).agg(F.max(p).alias("_top"))
    gate = F.max("_top").over(Window.orderBy(family).rowsBetween(Window.unboundedPreceding, -1))
    top = top.select(F.col(family).alias("_family"), F.coalesce(gate, F.lit(0.0)).alias("_gate"))
    return tests.join(top, F.col(family) == F.col("_family")).withColumn("p_adjusted", F.greatest(F.col(p), F.col("_gate"))).drop("_family", "_gate")
