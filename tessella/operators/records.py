"""Declared marks, scales, checks, documents and digests of records, and small group summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.core import pairs
from ..functions.draws import key
from ..functions.inside import beside, by_pattern, near, near_each, plus_one, shuffles, uniform_points

KEY = "pattern_id"
_COMPARE = {"at_least": Column.__ge__, "above": Column.__gt__, "at_most": Column.__le__, "below": Column.__lt__}


def threshold_mark(probability: Column, comparator: str, threshold: float) -> Column:
    """The declared binary mark of a probability; null stays null."""
    return _COMPARE[comparator](probability, F.lit(float(threshold))).cast("int")


def length_scales(points: DataFrame, area: float, fraction: float) -> DataFrame:
    """Diameter of the circle of a window's area, diagonal of the points' bounding box (null without
    two different points) and the largest scale that can be interpreted, a fraction of the diagonal."""
    box = points.groupBy(KEY).agg(F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("diagonal"))
    diagonal = F.when(F.col("diagonal") > 0, F.col("diagonal"))
    return box.select(KEY, F.lit(math.sqrt(4 * area / math.pi)).alias("equivalent_diameter"), diagonal.alias("diagonal"), (fraction * diagonal).alias("largest_scale"))


def stain_gradient(points: DataFrame, value: str, order: str = "idx") -> DataFrame:
    """Whether the local density drifts: eight values or more that span over 0.25, and whose first and
    second half differ by over 0.2 in the mean."""
    own = Window.partitionBy(KEY)
    v = points.where(F.col(value).isNotNull() & ~F.isnan(value)).select(KEY, F.col(value).alias("v"), F.row_number().over(own.orderBy(order)).alias("k"), F.count(F.lit(1)).over(own).alias("n"))
    first = F.col("k") <= F.floor(F.col("n") / 2)
    s = v.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), (F.max("v") - F.min("v")).alias("range"), (F.avg(F.when(~first, F.col("v"))) - F.avg(F.when(first, F.col("v")))).alias("drift"))
    return s.withColumn("suspect", (F.col("n") >= 8) & (F.col("range") > 0.25) & (F.abs("drift") > 0.2))


def eligible_everywhere(rows: DataFrame, by: Sequence[str], stratum: str, least: int) -> DataFrame:
    """Bins that every stratum supports with `least` rows or more, and how many strata there are."""
    k = rows.groupBy(*by, stratum).agg(F.count(F.lit(1)).alias("k"))
    return k.groupBy(*by).agg(F.count(F.lit(1)).alias("strata"), F.bool_and(F.col("k") >= least).alias("eligible"))


def normalised_label(label: Column) -> Column:
    """Trimmed, inner white space as one space, lower case; null if nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(label), r"\s+", " ")), F.lit(""))


def factor_map(rows: DataFrame, by: str, name: str, value: Column) -> DataFrame:
    """Each unit's factors as a map, keys in order."""
    own = rows.groupBy(by, name).agg(value.alias("_v"))
    return own.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "_v")))).alias("factors"))


def strict_json(text: Column, schema: T.StructType | str) -> Column:
    """A document of exactly this schema; anything malformed fails the job."""
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def content_digest(*fields: Column) -> Column:
    """SHA-256 over the fields' UTF-8 texts, each framed by its length in bytes; a null is framed as -1."""
    framed = [F.when(f.isNull(), F.lit("-1:")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*framed), 256)


def with_components(points: DataFrame, component: str) -> DataFrame:
    """All points of a pattern (component -1), and those of each of its components apart."""
    return points.withColumn("part", F.lit(-1)).unionByName(points.withColumn("part", F.col(component).cast("int")))


def interpretation(flags: Column, p: Column, alpha: float) -> Column:
    """What may be said: nothing where a flag stands, else whether the null is rejected."""
    return F.when(flags != "", F.concat(F.lit("suppressed: "), flags)).when(p.isNull(), "unavailable").when(p <= alpha, "structure beyond the null").otherwise("compatible with the null")


def block_share(m: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray, width: float, n: int, seed: int, groups: np.ndarray | None = None) -> tuple[float, float, float, float] | None:
    """One pattern's share, mean, sd and p of `block_share_null`; None where the marks have no spread."""
    p, v = np.nanmean(m), np.nanvar(m)
    if not v > 0:
        return None
    block = [np.nan_to_num(np.floor(c / width), nan=np.inf) for c in (x, y)]
    order = np.lexsort(block)
    new = np.any([b[order][1:] != b[order][:-1] for b in block], 0)
    starts, out = np.r_[0, np.flatnonzero(new) + 1], []
    for marks in shuffles(m, ids, n, seed, groups):
        marks = marks[:, order]
        k = np.add.reduceat((~np.isnan(marks)).astype(float), starts, axis=1)
        b = np.add.reduceat(np.nan_to_num(marks), starts, axis=1) / np.where(k > 0, k, 1)
        out.append((k * (b - p) ** 2).sum(1) / k.sum(1) / v)
    s = np.concatenate(out)
    null = s[1:]
    return s[0], null.mean(), null.std(ddof=1) if n > 1 else np.nan, plus_one(null, s[0])


def block_share_null(points: DataFrame, width: float, n: int, seed: int, stratum: str | None = None, mark: str = "mark") -> DataFrame:
    """Variance of the mean mark of square blocks over the variance of all marks, against shuffled
    marks, within strata if given -> pattern_id, share, mean, sd, p."""

    def run(_, pdf: pd.DataFrame) -> pd.DataFrame | None:
        m, x, y = (pdf[c].to_numpy(float) for c in (mark, "x", "y"))
        got = block_share(m, x, y, pdf["idx"].to_numpy(), width, n, seed, pd.factorize(pdf[stratum])[0] if stratum else None)
        return got and pd.DataFrame([got], columns=["share", "mean", "sd", "p"])

    return by_pattern(points, ["idx", "x", "y", mark, *[stratum] * bool(stratum)], run, "share double, mean double, sd double, p double")


def null_sensitivity(free: DataFrame, within: DataFrame, alpha: float) -> DataFrame:
    """Two nulls side by side -> pattern_id, p_free, p_within, conclusion: robust, confounded (only the
    free null is rejected), masked, none, or degenerate (the null within strata has no spread)."""
    a, b = free.select(KEY, F.col("p").alias("p_free")), within.select(KEY, F.col("p").alias("p_within"), "sd")
    low, inner = F.col("p_free") <= alpha, F.col("p_within") <= alpha
    said = F.when(F.col("sd") <= 1e-12, "degenerate").when(low & inner, "robust").when(low, "confounded").when(inner, "masked").otherwise("none")
    return a.join(b, KEY).select(KEY, "p_free", "p_within", said.alias("conclusion"))


def group_contrast(rows: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """Mean of a value in both groups of a binary mark, their difference and ratio; null without both."""
    m = lambda g: F.avg(F.when(F.col(group) == g, F.col(value)))
    s = rows.groupBy(*by).agg(F.count(F.when(F.col(group) == 1, 1)).alias("marked"), F.count(F.when(F.col(group) == 0, 1)).alias("unmarked"), m(1).alias("m1"), m(0).alias("m0"))
    return s.select(*by, "marked", "unmarked", (F.col("m1") - F.col("m0")).alias("difference"), F.when(F.col("m0") != 0, F.col("m1") / F.col("m0")).alias("ratio"))


def embedding_mark_energies(rows: DataFrame, components: Sequence[str], mark: str) -> DataFrame:
    """Mean squared difference of both groups' centroids, and mean squared covariance of mark and
    component, over the components -> pattern_id, discrepancy (null without both groups), energy."""
    m = lambda g, c: F.avg(F.when(F.col(mark) == g, F.col(c)))
    s = rows.groupBy(KEY).agg(*[x for c in components for x in ((m(1, c) - m(0, c)).alias(f"d_{c}"), F.covar_pop(mark, c).alias(f"c_{c}"))])
    mean = lambda p: sum((F.col(f"{p}_{c}") * F.col(f"{p}_{c}") for c in components), F.lit(0.0)) / len(components)
    return s.select(KEY, mean("d").alias("discrepancy"), mean("c").alias("energy"))


def support_mixing(points: DataFrame, radius: float, label: str, support: str) -> DataFrame:
    """Directed neighbour pairs of each two classes, by number and by the product of both supports ->
    pattern_id, source, target, pairs, mass, share of pairs and of mass from that source."""
    met = pairs(points, None, radius, [label, support])
    k = met.groupBy(KEY, F.col(f"i_{label}").alias("source"), F.col(f"j_{label}").alias("target")).agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col(f"i_{support}") * F.col(f"j_{support}")).alias("mass"))
    own = Window.partitionBy(KEY, "source")
    mass = F.sum("mass").over(own)
    return k.select(KEY, "source", "target", "pairs", "mass", (F.col("pairs") / F.sum("pairs").over(own)).alias("share"), F.when(mass > 0, F.col("mass") / mass).alias("mass_share"))


def top1_mixing_bounds(points: DataFrame, radius: float, classes: Sequence[str], declared: int, label: str, confidence: str) -> DataFrame:
    """Bounds of the mean product of class probabilities of neighbours when only the winner's is known.

    The winner of `declared` classes has its probability p; any other class has at least
    1 - (declared - 1) p (zero if negative) and at most min(p, 1 - p). Pairs go both ways.
    """
    p, n = F.col(confidence), declared
    low, high = F.greatest(F.lit(0.0), 1 - (n - 1) * p), F.least(p, 1 - p)
    own = points.withColumns({f"{s}_{k}": F.when(F.col(label) == c, p).otherwise(b) for k, c in enumerate(classes) for s, b in (("lo", low), ("hi", high))})
    cols = [f"{s}_{k}" for k in range(len(classes)) for s in ("lo", "hi")]
    met = pairs(own, None, radius, cols)
    at = [(a, b) for a in range(len(classes)) for b in range(len(classes))]
    sums = met.groupBy(KEY).agg(F.count(F.lit(1)).alias("pairs"), *[F.avg(F.col(f"i_{s}_{a}") * F.col(f"j_{s}_{b}")).alias(f"{s}_{a}_{b}") for a, b in at for s in ("lo", "hi")])
    each = F.explode(F.array(*[F.struct(F.lit(classes[a]).alias("a"), F.lit(classes[b]).alias("b"), F.col(f"lo_{a}_{b}").alias("lower"), F.col(f"hi_{a}_{b}").alias("upper")) for a, b in at])).alias("v")
    return sums.select(KEY, "pairs", each).select(KEY, "pairs", "v.*")


def compartment_raster(points: DataFrame, width: float, mark: str = "mark") -> DataFrame:
    """pattern_id, gx, gy, side: raster cells with points, positive where at least half are marked."""
    g = lambda c: F.floor(F.col(c) / width).cast("int")
    return points.groupBy(KEY, g("x").alias("gx"), g("y").alias("gy")).agg((F.avg(mark) >= 0.5).alias("side"))


def compartment_contact(raster: DataFrame, width: float) -> DataFrame:
    """Boundary of each compartment: shared with the other one, outer, and the share that is shared."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dz")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("s")
    faces = raster.select(KEY, "side", "gx", "gy", step).select(KEY, "side", (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dz")).alias("gy"))
    met = faces.join(raster.withColumnRenamed("side", "other"), [KEY, "gx", "gy"], "left")
    s = met.groupBy(KEY, "side").agg((F.count(F.when(F.col("other") != F.col("side"), 1)) * width).alias("shared"), (F.count(F.when(F.col("other").isNull(), 1)) * width).alias("outer"))
    return s.withColumn("contact", F.when(F.col("shared") + F.col("outer") > 0, F.col("shared") / (F.col("shared") + F.col("outer"))))


def compartment_fragments(raster: DataFrame, width: float, rounds: int = 400) -> DataFrame:
    """Components of each compartment's raster cells that share sides: their number, the largest one's
    share of the area, entropy of the areas in nats and over its maximum."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cells, sizes = set(zip(pdf["gx"].tolist(), pdf["gy"].tolist())), []
        while cells:
            todo, n = [cells.pop()], 0
            while todo:
                x, y = todo.pop()
                n += 1
                for at in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if at in cells:
                        cells.remove(at)
                        todo.append(at)
            sizes.append(n)
        total = sum(sizes)
        entropy = -sum(k / total * math.log(k / total) for k in sizes)
        return pd.DataFrame({KEY: [pdf[KEY].iloc[0]], "side": [pdf["side"].iloc[0]], "components": [len(sizes)], "area": [total * width * width], "largest_share": [max(sizes) / total], "entropy": [entropy + 0.0], "normalised": [entropy / math.log(len(sizes)) if len(sizes) > 1 else 0.0]})

    return raster.groupBy(KEY, "side").applyInPandas(run, "pattern_id long, side boolean, components long, area double, largest_share double, entropy double, normalised double")


def exact_max_t(rows: DataFrame, endpoint: str, unit: str, first: Sequence[int], value: str = "value") -> DataFrame:
    """Adjusted p of each endpoint over all relabellings of the units, from the largest |difference| of
    means over endpoints. Meant for a dozen units: all choices of as many are enumerated by bits."""
    names = sorted(r[0] for r in rows.select(unit).distinct().collect())  # a dozen units
    chosen = sum(1 << names.index(u) for u in first)
    masks = rows.sparkSession.range(1 << len(names)).where(F.bit_count("id") == len(first)).withColumnRenamed("id", "mask")
    bit = F.broadcast(rows.sparkSession.createDataFrame([(u, k) for k, u in enumerate(names)], f"{unit} {rows.schema[unit].dataType.simpleString()}, bit int"))
    every = rows.join(bit, unit).crossJoin(F.broadcast(masks)).withColumn("g", F.expr("shiftright(mask, bit) & 1"))
    d = every.groupBy("mask", endpoint).agg(F.abs(F.avg(F.when(F.col("g") == 1, F.col(value))) - F.avg(F.when(F.col("g") == 0, F.col(value)))).alias("d"))
    top = d.groupBy("mask").agg(F.max("d").alias("m"))
    seen = d.where(F.col("mask") == chosen).select(endpoint, F.col("d").alias("statistic"))
    return seen.crossJoin(F.broadcast(top)).groupBy(endpoint, "statistic").agg(F.count(F.lit(1)).alias("labellings"), F.avg((F.col("m") >= F.col("statistic") - 1e-12).cast("double")).alias("p_adjusted"))


def interference(points: DataFrame, radius: float, n: int, seed: int, treated: str = "mark", outcome: str = "value") -> DataFrame:
    """Mean outcome difference of untreated units with and without a treated neighbour, against
    treatments shuffled within the pattern -> pattern_id, exposed, isolated, effect, p (two-sided)."""

    def run(_, pdf: pd.DataFrame) -> pd.DataFrame | None:
        x, y, t, o = (pdf[c].to_numpy(float) for c in ("x", "y", treated, outcome))
        known, value, effects, seen = ~np.isnan(o), np.nan_to_num(o), [], None
        for marks in shuffles(t, pdf["idx"].to_numpy(), n, seed):
            near_one, free = beside((marks > 0).astype(float), near(x, y, radius)) > 0, marks == 0
            one, none = free & near_one, free & ~near_one
            if seen is None:
                seen = int((one[0] & known).sum()), int((none[0] & known).sum())
            with np.errstate(invalid="ignore", divide="ignore"):
                effects.append((one @ value) / (one @ known.astype(float)) - (none @ value) / (none @ known.astype(float)))
        if not (t == 0).any():
            return None
        e = np.concatenate(effects)
        p = (1 + (np.abs(e[1:]) >= abs(e[0]) - 1e-12).sum()) / (n + 1)
        return pd.DataFrame({"exposed": [seen[0]], "isolated": [seen[1]], "effect": [e[0]], "p": [p]})

    return by_pattern(points, ["idx", "x", "y", treated, outcome], run, "exposed long, isolated long, effect double, p double")


def information_gain(rows: DataFrame, by: str, prior: float, noise: float) -> DataFrame:
    """Expected information of a unit's observations about its mean: both Gaussian, in nats."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).withColumn("gain", 0.5 * F.log(1 + F.col("n") * prior / noise)).withColumn("posterior_variance", 1 / (1 / prior + F.col("n") / noise))


def random_labels(patterns: DataFrame, n: int, fraction: float, spacing: float, seed: int) -> DataFrame:
    """A row of n cells for each pattern of which a fixed share is marked, at random places."""
    cells = patterns.select(KEY).distinct().select(KEY, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
    rank = F.row_number().over(Window.partitionBy(KEY).orderBy(key(seed, KEY, "idx"), "idx"))
    return cells.select(KEY, F.col("idx").cast("long").alias("idx"), (F.col("idx") * float(spacing)).alias("x"), F.lit(0.0).alias("y"), (rank <= round(fraction * n)).cast("int").alias("mark"))


def soft_pair_histogram(points: DataFrame, centres: Sequence[float], width: float) -> DataFrame:
    """Unordered pairs per distance, each spread over the centres by a Gaussian -> pattern_id, bin, weight."""
    most = max(centres) + 3 * width
    met = pairs(points, None, most, unordered=True).withColumn("d", F.sqrt("d2"))
    w = lambda c: F.sum(F.exp(-0.5 * ((F.col("d") - c) / width) ** 2))
    s = met.groupBy(KEY).agg(*[w(float(c)).alias(f"w{k}") for k, c in enumerate(centres)])
    return s.select(KEY, F.posexplode(F.array(*[F.col(f"w{k}") for k in range(len(centres))])).alias("bin", "weight"))


def matching_loss(summaries: DataFrame, scale: DataFrame) -> DataFrame:
    """Mean over bins of the squared relative gap between a pattern's summary and a target(bin, target)."""
    met = summaries.join(F.broadcast(scale), "bin")  # a row a bin
    gap = (F.col("weight") - F.col("target")) / F.col("target")
    return met.groupBy(KEY).agg(F.avg(gap * gap).alias("loss"))


def close_pair_check(points: DataFrame, radius: float, window: tuple[float, float, float, float], n: int, seed: int) -> DataFrame:
    """Close pairs of each pattern against as many uniform points, n times -> pattern_id, observed,
    mean, low and high (2.5 and 97.5 % nearest rank), p_high."""

    def run(of, pdf: pd.DataFrame) -> pd.DataFrame:
        seen = sum(len(i) for i, _, _ in near(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), radius))
        count = lambda x, y: sum(np.bincount(i // len(pdf), minlength=len(x)) for i, _, _ in near_each(x, y, radius)) + np.zeros(len(x), int)
        k = np.concatenate([count(*p) for p in uniform_points(of, len(pdf), window, n, seed)])
        at = lambda p: np.sort(k)[max(1, math.ceil(p * n)) - 1]
        return pd.DataFrame({"observed": [seen], "mean": [k.mean()], "low": [at(0.025)], "high": [at(0.975)], "p_high": [plus_one(k, seen)]})

    return by_pattern(points, ["x", "y"], run, "observed long, mean double, low long, high long, p_high double", order=None)


def calibration(scores: DataFrame, by: str, label: str = "label", score: str = "score", eps: float = 1e-6) -> DataFrame:
    """Log loss, Brier score, calibration in the large and the least-squares slope of label on score."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), F.col(score)))
    y = F.col(label).cast("double")
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    return scores.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("log_loss"), F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"), (F.avg(y) - F.avg(score)).alias("in_the_large"), F.regr_slope(y, F.col(score)).alias("slope"))


def draw_diagnostics(draws: DataFrame, parameter: str, chain: str, iteration: str, value: str, most: float, least: float) -> DataFrame:
    """Split R-hat and effective draws (from the lag-one autocorrelation) of each parameter, and whether
    both pass -> parameter, draws, r_hat, effective, passed."""
    own = Window.partitionBy(parameter, chain)
    d = draws.withColumn("half", F.ntile(2).over(own.orderBy(iteration)))
    d = d.withColumn("before", F.lag(value).over(Window.partitionBy(parameter, chain, "half").orderBy(iteration)))
    c = d.groupBy(parameter, chain, "half").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.corr(value, "before").alias("r"))
    s = c.groupBy(parameter).agg(F.sum("n").alias("draws"), F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.avg("r").alias("r"))
    r_hat = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("b")) / F.col("w"))
    ess = F.least(F.col("draws").cast("double"), F.col("draws") * (1 - F.col("r")) / (1 + F.col("r")))
    return s.select(parameter, "draws", r_hat.alias("r_hat"), ess.alias("effective"), ((r_hat <= most) & (ess >= least)).alias("passed"))


def autoregressive_form(points: DataFrame, radius: float, alpha: float, value: str = "value") -> DataFrame:
    """Of each pattern's neighbour weights W and degrees D: links, the conditional autoregressive form
    f'(D - alpha W) f of the centred values, and the correlation of values with their row-standardised lag."""
    own = Window.partitionBy(KEY)
    f = points.select(KEY, "idx", "x", "y", (F.col(value) - F.avg(value).over(own)).alias("f"))
    met = pairs(f, None, radius, ["f"])
    lag = met.groupBy(KEY, F.col("i").alias("idx")).agg(F.count(F.lit(1)).alias("degree"), F.first("i_f").alias("f"), F.sum("j_f").alias("s"))
    form = F.sum(F.col("degree") * F.col("f") * F.col("f") - alpha * F.col("f") * F.col("s"))
    return lag.groupBy(KEY).agg(F.sum("degree").alias("links"), form.alias("form"), F.corr("f", F.col("s") / F.col("degree")).alias("lag_correlation"))
