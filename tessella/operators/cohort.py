"""Patient-level inference: contrasts, pooled effects, distances, ranks and prediction scores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.draws import orders, shuffled


def welch(endpoints: DataFrame, first: str, second: str, *by: str, group: str = "grp", value: str = "value") -> DataFrame:
    """Mean difference, standard error and t of two groups; null below two rows each or without spread."""
    side = lambda g: F.when(F.col(group) == g, F.col(value))
    s = endpoints.groupBy(*by).agg(*[f(side(g)).alias(f"{n}{k}") for k, g in enumerate((first, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    se = F.sqrt(F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1"))
    good = (F.col("n0") > 1) & (F.col("n1") > 1) & (se > 0)
    return s.select(*by, F.col("n0").alias("n_first"), F.col("n1").alias("n_second"), (F.col("m0") - F.col("m1")).alias("difference"), F.when(good, se).alias("standard_error"), F.when(good, (F.col("m0") - F.col("m1")) / se).alias("t"))


def _t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's t by the incomplete beta's continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + top * d
                c = 1 + top / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h

    whole = 1.0 if x >= 1 else front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
    return whole / 2 if t >= 0 else 1 - whole / 2


def equivalence(effects: DataFrame, margin: float, alpha: float, *by: str, effect: str = "effect") -> DataFrame:
    """Two one-sided t tests of a mean effect against both margins."""
    s = effects.groupBy(*by).agg(F.count(effect).alias("n"), F.avg(effect).alias("mean"), (F.stddev_samp(effect) / F.sqrt(F.count(effect))).alias("se"))
    s = s.withColumn("t_low", (F.col("mean") + margin) / F.col("se")).withColumn("t_high", (margin - F.col("mean")) / F.col("se"))

    @F.pandas_udf("double")
    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_t_tail(a, k - 1) if k > 1 and a == a else None for a, k in zip(t, n)], dtype="float64")

    s = s.withColumn("p_low", tail("t_low", "n")).withColumn("p_high", tail("t_high", "n"))
    return s.withColumn("equivalent", F.greatest("p_low", "p_high") < alpha)


def multisite(sites: DataFrame, effect: str = "effect", se: str = "standard_error") -> DataFrame:
    """Inverse-variance pooled effect, its error, heterogeneity Q and moment estimate of its variance."""
    w = 1 / (F.col(se) * F.col(se))
    s = sites.agg(F.count(F.lit(1)).alias("sites"), F.sum(w).alias("w"), F.sum(w * w).alias("ww"), F.sum(w * F.col(effect)).alias("wx"), F.sum(w * F.col(effect) * F.col(effect)).alias("wxx"))
    q = F.col("wxx") - F.col("wx") * F.col("wx") / F.col("w")
    tau2 = F.greatest(F.lit(0.0), (q - (F.col("sites") - 1)) / (F.col("w") - F.col("ww") / F.col("w")))
    return s.select("sites", (F.col("wx") / F.col("w")).alias("pooled"), F.sqrt(1 / F.col("w")).alias("standard_error"), q.alias("q"), tau2.alias("tau2"))


def auroc(scores: DataFrame, *by: str, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties one half, and the Brier score. Only distinct scores are ordered."""
    y, gap = F.col(label), F.col(score) - F.col(label)
    at = scores.groupBy(*by, score).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("m"), F.count(F.lit(1)).alias("k"), F.sum(gap * gap).alias("b"))
    below = F.coalesce(F.sum("m").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = at.withColumn("won", F.col("p") * (below + F.col("m") / 2))
    area = F.sum("won") / F.nullif((F.sum("p") * F.sum("m")).cast("double"), F.lit(0.0))
    return won.groupBy(*by).agg(F.sum("k").alias("n"), F.sum("p").cast("long").alias("positives"), area.alias("auroc"), (F.sum("b") / F.sum("k")).alias("brier"))


def average_precision(scores: DataFrame, *by: str, label: str = "label", score: str = "score") -> DataFrame:
    """Sum of precision at each threshold times the recall it adds; equal scores share a threshold."""
    at = scores.groupBy(*by, score).agg(F.count(F.lit(1)).alias("k"), F.sum(label).alias("p"))
    down = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = at.withColumn("tp", F.sum("p").over(down)).withColumn("n", F.sum("k").over(down))
    return run.groupBy(*by).agg((F.sum(F.col("tp") / F.col("n") * F.col("p")) / F.nullif(F.sum("p").cast("double"), F.lit(0.0))).alias("average_precision"))


def reliability(scores: DataFrame, bins: int, *by: str, label: str = "label", score: str = "score") -> DataFrame:
    """Mean score and observed share per equal-width score bin."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("share"))


def nested_mean(fields: DataFrame, levels_: Sequence[str], value: str = "value") -> DataFrame:
    """Means of means from the innermost level up to the first."""
    out = fields
    for k in range(len(levels_), 0, -1):
        out = out.groupBy(*levels_[:k]).agg(F.avg(value).alias(value))
    return out


def permutation_contrasts(endpoints: DataFrame, replicates: int, seed: int, *by: str, id_col: str, group: str = "is_first", value: str = "value") -> DataFrame:
    """Observed and permuted studentised mean differences of each unit: by, replicate (0: observed),
    statistic. Group labels are shuffled within the unit; each replicate's difference is divided by
    its own standard error. Without spread or two rows a group the statistic is null."""
    own = endpoints.select(*by, id_col, F.col(group).cast("boolean").alias("g"), F.col(value).cast("double").alias("v"))
    labels = shuffled(own, list(by), [id_col], ["g"], replicates, seed)
    every = own.withColumn("replicate", F.lit(0)).unionByName(labels.join(own.select(*by, id_col, "v"), [*by, id_col]))
    side = lambda g: F.when(F.col("g") == g, F.col("v"))
    s = every.groupBy(*by, "replicate").agg(*[f(side(g)).alias(f"{n}{k}") for k, g in enumerate((True, False)) for n, f in (("n", F.count), ("m", F.avg), ("s", F.var_samp))])
    se = F.sqrt(F.col("s0") / F.col("n0") + F.col("s1") / F.col("n1"))
    good = (F.col("n0") > 1) & (F.col("n1") > 1) & (se > 0)
    return s.select(*by, F.col("replicate").cast("long").alias("replicate"), F.when(good, (F.col("m0") - F.col("m1")) / se).alias("statistic"))


def max_t(null: DataFrame, endpoint: str, alpha: float = 0.05) -> DataFrame:
    """Single-step adjusted p-values: (1 + how often the largest |statistic| reaches an endpoint's) / (B + 1)."""
    top = null.where("replicate > 0").groupBy("replicate").agg(F.max(F.abs("statistic")).alias("m"))
    seen = null.where("replicate = 0").select(endpoint, F.abs("statistic").alias("s"))
    return seen.join(F.broadcast(top), F.lit(True)).groupBy(endpoint).agg(F.first("s").alias("statistic"), ((1 + F.sum((F.col("m") >= F.col("s")).cast("int"))) / (1 + F.count(F.lit(1)))).alias("p_adjusted"))


def group_shares(df: DataFrame, value: Column, *by: str) -> DataFrame:
    k = df.groupBy(*by, value.alias("level")).agg(F.count(F.lit(1)).alias("k"))
    return k.withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy(*by)))



def manski_bounds(units: DataFrame, low: float, high: float, *by: str, treated: str = "treated", outcome: str = "outcome") -> DataFrame:
    """Bounds of the mean effect when nothing is assumed about the unseen outcomes in [low, high]."""
    p = F.avg(F.col(treated).cast("double"))
    y1, y0 = F.avg(F.when(F.col(treated) == 1, F.col(outcome))), F.avg(F.when(F.col(treated) == 0, F.col(outcome)))
    s = units.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), p.alias("p"), F.coalesce(y1, F.lit(0.0)).alias("y1"), F.coalesce(y0, F.lit(0.0)).alias("y0"))
    top = F.col("y1") * F.col("p") + high * (1 - F.col("p")) - F.col("y0") * (1 - F.col("p")) - low * F.col("p")
    bottom = F.col("y1") * F.col("p") + low * (1 - F.col("p")) - F.col("y0") * (1 - F.col("p")) - high * F.col("p")
    return s.select(*by, "n", bottom.alias("lower"), top.alias("upper"))


def freedman_lane(records: DataFrame, replicates: int, seed: int, *by: str, outcome: str = "value", group: str = "is_first", covariates: Sequence[str] = (), id_col: str | None = None) -> DataFrame:
    """Group coefficient given covariates, with a two-sided p-value over permuted residuals of the
    reduced model. A unit without residual freedom or with a collinear group has nulls."""

    def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        q, r = np.linalg.qr(x)
        return np.linalg.solve(r, q.T @ y)

    def t_values(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = fit(x, y)
        s2 = ((y - x @ b) ** 2).sum(0) / (len(x) - x.shape[1])
        return b[-1], b[-1] / np.sqrt(s2 * np.linalg.inv(x.T @ x)[-1, -1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col] if id_col else [outcome, group, *covariates])
        y, g = pdf[outcome].to_numpy(float), pdf[group].to_numpy(float)
        reduced = np.column_stack([np.ones(len(y)), *(pdf[c].to_numpy(float) for c in covariates)])
        full, row = np.column_stack([reduced, g]), {**{c: pdf[c].iloc[0] for c in by}, "coefficient": None, "t": None, "p": None}
        if len(y) > full.shape[1] and np.linalg.matrix_rank(full) == full.shape[1]:
            b, t = t_values(full, y[:, None])
            fitted = reduced @ fit(reduced, y)
            order = orders(pdf[id_col].tolist() if id_col else range(len(y)), seed, replicates)
            _, null = t_values(full, fitted[:, None] + (y - fitted)[order].T)
            row |= {"coefficient": b[0], "t": t[0], "p": (1 + int((np.abs(null) >= abs(t[0]) - 1e-12).sum())) / (1 + replicates)}
        return pd.DataFrame([row]).astype({c: "float64" for c in ("coefficient", "t", "p")})

    kinds = {f.name: f.dataType.simpleString() for f in records.schema.fields}
    return records.groupBy(*by).applyInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "coefficient double", "t double", "p double"]))
