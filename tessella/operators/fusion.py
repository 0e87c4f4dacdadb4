"""Two sections of a tissue brought into one frame: fusion, registration checks, labels, curves and territories."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import pairs
from ..functions.inside import BANDS, band_rows, by_pattern, counted, near, shuffles

KEY = "pattern_id"


def projected(x: Column, y: Column, affine: Sequence[float]) -> tuple[Column, Column]:
    """(x, y) under the affine map a x + b y + c, d x + e y + f."""
    a, b, c, d, e, f = map(float, affine)
    return a * x + b * y + c, d * x + e * y + f


def primary_label(section: Column, cell_type: Column, mark: Column, probability: Column) -> Column:
    """A stained cell's state by its mark, else by its probability; any other cell's trimmed type, null if blank."""
    state = F.when(mark == 1, "mmr_abnormal").when(mark == 0, "mmr_retained").when(probability >= 0.5, "mmr_abnormal").when(probability < 0.5, "mmr_retained")
    return F.when(section == "ihc", state).otherwise(F.nullif(F.trim(cell_type), F.lit("")))


def fused(he: DataFrame, ihc: DataFrame, affine: Sequence[float]) -> DataFrame:
    """he(pattern_id, idx, x, y, cell_type) projected into the frame of ihc(..., mark, probability),
    one table of both: pattern_id, section, idx, x, y, primary."""
    x, y = projected(F.col("x"), F.col("y"), affine)
    none = lambda t: F.lit(None).cast(t)
    a = he.select(KEY, F.lit("he").alias("section"), "idx", x.alias("x"), y.alias("y"), F.col("cell_type"), none("int").alias("mark"), none("double").alias("probability"))
    b = ihc.select(KEY, F.lit("ihc").alias("section"), "idx", "x", "y", none("string").alias("cell_type"), "mark", "probability")
    both = a.unionByName(b)
    return both.select(KEY, "section", "idx", "x", "y", primary_label(F.col("section"), F.col("cell_type"), F.col("mark"), F.col("probability")).alias("primary"))


def _cross(ax: str, ay: str, bx: str, by: str, px: str, py: str) -> Column:
    c = F.col
    return (c(bx) - c(ax)) * (c(py) - c(ay)) - (c(by) - c(ay)) * (c(px) - c(ax))


def hull_edges(points: DataFrame) -> DataFrame:
    """Directed edges (ax, ay, bx, by) of each pattern's convex hull, all points on their left or on
    them. Meant for a few dozen landmarks a pattern, whose triples it compares."""
    side = lambda n: points.select(KEY, F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    edges = side("a").join(side("b"), KEY).where((F.col("ax") != F.col("bx")) | (F.col("ay") != F.col("by"))).distinct()
    worst = edges.join(side("p"), KEY).groupBy(KEY, "ax", "ay", "bx", "by").agg(F.min(_cross("ax", "ay", "bx", "by", "px", "py")).alias("least"))
    return worst.where(F.col("least") >= 0).drop("least")


def hull_contains(points: DataFrame, landmarks: DataFrame) -> DataFrame:
    """pattern_id, idx, inside: whether a point is in the hull of its pattern's landmarks, edge included."""
    met = points.select(KEY, "idx", F.col("x").alias("px"), F.col("y").alias("py")).join(hull_edges(landmarks), KEY)
    return met.groupBy(KEY, "idx").agg((F.min(_cross("ax", "ay", "bx", "by", "px", "py")) >= 0).alias("inside"))


def registration_qc(landmarks: DataFrame, affine: Sequence[float], multiplier: float) -> DataFrame:
    """Residuals of landmarks(pattern_id, x, y, target_x, target_y) under a map: their root mean
    square, median, nearest-rank 95 % and largest, and the least distance that claims can rest on."""
    x, y = projected(F.col("x"), F.col("y"), affine)
    r = landmarks.withColumn("r", F.hypot(x - F.col("target_x"), y - F.col("target_y")))
    own = Window.partitionBy(KEY)
    ranked = r.withColumn("k", F.row_number().over(own.orderBy("r"))).withColumn("n", F.count(F.lit(1)).over(own))
    p95 = F.max(F.when(F.col("k") == F.ceil(F.col("n") * F.lit(95) / 100), F.col("r")))
    out = ranked.groupBy(KEY).agg(F.count(F.lit(1)).alias("landmarks"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"), F.percentile("r", 0.5).alias("median"), p95.alias("p95"), F.max("r").alias("largest"))
    return out.withColumn("usable_distance", F.col("p95") * multiplier)


def cross_interaction(cells: DataFrame, label_pairs: Sequence[tuple[str, str]], width: float, most: float, n: int, seed: int, alpha: float, label: str = "primary", section: str = "section") -> DataFrame:
    """Unordered pairs of two labels per distance bin, with the global envelope over labels shuffled
    within sections -> pattern_id, a, b, bin, observed, lower, upper, outside, p_global."""
    bins = int(-(-most // width))
    wanted = [(min(p), max(p)) for p in label_pairs]
    names = sorted({c for p in wanted for c in p})

    def run(_, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, k = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), len(names)
        labels = pd.Categorical(pdf[label], categories=names).codes.astype(np.int64)  # any other label: -1
        curves = []
        for drawn in shuffles(labels, pdf["idx"].to_numpy(), n, seed, pd.factorize(pdf[section], use_na_sentinel=False)[0]):
            total = np.zeros((len(drawn), bins * k * k), np.int64)
            for i, j, d2 in near(x, y, most):
                bin_ = np.minimum(np.floor(np.sqrt(d2) / width), bins - 1).astype(np.int64)
                a, b = drawn[:, i], drawn[:, j]
                low, high = np.minimum(a, b), np.maximum(a, b)
                total += counted(np.where(low < 0, -1, (low * k + high) * bins + bin_), bins * k * k)
            curves.append(total.reshape(len(drawn), k, k, bins).astype(float))
        every = np.concatenate(curves)
        return pd.concat([band_rows(every[:, names.index(a), names.index(b)], range(bins), alpha, a=a, b=b) for a, b in wanted])

    return by_pattern(cells, ["idx", "x", "y", label, section], run, "a string, b string, " + BANDS)


def territory_profiles(cells: DataFrame, centres: DataFrame, radius: float, label: str = "primary") -> DataFrame:
    """Share of each label among the labelled cells of a territory -> pattern_id, territory, label, cells, share."""
    met = pairs(centres, cells.select(KEY, "idx", "x", "y", label).withColumnRenamed(label, "l"), radius, []).select(KEY, F.col("i").alias("territory"), F.col("j").alias("idx"))
    held = met.join(cells.select(KEY, "idx", F.col(label).alias("label")), [KEY, "idx"]).where("label is not null").groupBy(KEY, "territory", "label").agg(F.count(F.lit(1)).alias("cells"))
    return held.withColumn("share", F.col("cells") / F.sum("cells").over(Window.partitionBy(KEY, "territory")))


def territory_comparison(profiles: DataFrame, margin: float) -> DataFrame:
    """Pairs of territories of a pattern: the largest difference of a label's share, and whether it
    stays within the margin -> pattern_id, first, second, difference, alike."""
    labels = profiles.select(KEY, "label").distinct()
    full = profiles.select(KEY, "territory").distinct().join(labels, KEY).join(profiles, [KEY, "territory", "label"], "left").fillna(0.0, ["share"])
    a, b = (full.select(KEY, "label", F.col("territory").alias(t), F.col("share").alias(s)) for t, s in (("first", "sa"), ("second", "sb")))
    met = a.join(b, [KEY, "label"]).where("first < second")
    return met.groupBy(KEY, "first", "second").agg(F.max(F.abs(F.col("sa") - F.col("sb"))).alias("difference")).withColumn("alike", F.col("difference") <= margin + 1e-9)
