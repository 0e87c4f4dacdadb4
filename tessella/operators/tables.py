"""Aggregates over cell tables: admission, quality fractions, grids, censuses, information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def admitted(cells: DataFrame, inside: Column, required: Sequence[str], excluded: Sequence[str]) -> DataFrame:
    """Cells inside the mask whose required flags hold and excluded ones don't; null flags reject."""
    test = inside
    for c in required:
        test = test & F.coalesce(F.col(c), F.lit(False))
    for c in excluded:
        test = test & ~F.coalesce(F.col(c), F.lit(True))
    return cells.where(test)


def flag_fractions(cells: DataFrame, flags: Sequence[str], *by: str) -> DataFrame:
    """Share of rows with each flag."""
    return cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).cast("int")).alias(c) for c in flags])


def mark_summary(points: DataFrame, *by: str) -> DataFrame:
    """Counts, prevalence, mean, variances and exact median of marks."""
    v = "value"
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("mark").cast("long").alias("marked"), F.avg("mark").alias("prevalence"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.var_samp(v).alias("sample_variance"), F.percentile(v, 0.5).alias("median"))


def nearest_rank(points: DataFrame, share: float, value: str, *by: str) -> DataFrame:
    """The ceil(share * n)-th smallest value."""
    w = Window.partitionBy(*by)
    rows = points.select(*by, value, F.row_number().over(w.orderBy(value)).alias("at"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.where(F.col("at") == F.ceil(F.lit(share) * F.col("n"))).select(*by, F.col(value).alias("percentile"))


def validation_flags(points: DataFrame, least: int, least_marked: int, least_unmarked: int, low: float, high: float, *by: str) -> DataFrame:
    """Which minimum requirements a pattern misses."""
    s = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("mark").alias("m"))
    return s.select(*by, "n", flags(least, least_marked, least_unmarked, low, high).alias("flags"))


def flags(least: int, least_marked: int, least_unmarked: int, low: float, high: float) -> Column:
    """What n cells of which m are marked miss."""
    tests = {"too_few_cells": F.col("n") < least, "too_few_marked": F.col("m") < least_marked, "too_few_unmarked": F.col("n") - F.col("m") < least_unmarked, "prevalence_out_of_range": (F.col("m") / F.col("n") < low) | (F.col("m") / F.col("n") > high)}
    return F.concat_ws(",", *[F.when(t, name) for name, t in tests.items()])


def quadrats(points: DataFrame, width: float, *by: str) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / float(width)).cast("long")
    return points.groupBy(*by, cell("x").alias("gx"), cell("y").alias("gy")).agg(F.count(F.lit(1)).alias("k"))


def morisita(points: DataFrame, widths: Sequence[float], side: float, *by: str) -> DataFrame:
    """q * sum n(n-1) / (N(N-1)) over q square quadrats, for each width."""
    out = None
    for w in widths:
        q = float(round(side / w) ** 2)
        one = quadrats(points, w, *by).groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * (F.col("k") - 1)).alias("s")).where("n > 1").select(*by, F.lit(float(w)).alias("width"), (F.lit(q) * F.col("s") / (F.col("n") * (F.col("n") - 1))).alias("morisita"))
        out = one if out is None else out.union(one)
    return out


def box_dimension(points: DataFrame, widths: Sequence[float], *by: str) -> DataFrame:
    """Slope of log occupied boxes over log inverse width."""
    out = None
    for w in widths:
        one = quadrats(points, w, *by).groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("boxes")).withColumn("w", F.lit(float(w)))
        out = one if out is None else out.union(one)
    return out.groupBy(*by).agg((-F.regr_slope(F.log("boxes"), F.log("w"))).alias("dimension"), F.max("boxes").cast("long").alias("finest_boxes"))


def scale_energies(points: DataFrame, width: float, cells: int, *by: str) -> DataFrame:
    """Variance shares of a rasterised mark: neighbour differences, 2x2 block means, and the total."""
    cell = lambda c: F.floor(F.col(c) / float(width)).cast("long")
    grid = points.groupBy(*by, cell("x").alias("gx"), cell("y").alias("gy")).agg(F.sum("mark").cast("double").alias("v"))
    line = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
    full = points.select(*by).distinct().select(*by, line.alias("gx")).select(*by, "gx", line.alias("gy"))
    grid = full.join(grid, [*by, "gx", "gy"], "left").fillna(0.0, ["v"])
    right = Window.partitionBy(*by, "gy").orderBy("gx")
    down = Window.partitionBy(*by, "gx").orderBy("gy")
    diff = grid.withColumn("r", F.lead("v").over(right)).withColumn("d", F.lead("v").over(down))
    total = diff.groupBy(*by).agg(F.var_pop("v").alias("total"), F.sum((F.col("v") - F.col("r")) * (F.col("v") - F.col("r"))).alias("dr"), F.sum((F.col("v") - F.col("d")) * (F.col("v") - F.col("d"))).alias("dd"), F.count("r").alias("nr"), F.count("d").alias("nd"))
    blocks = grid.groupBy(*by, F.floor(F.col("gx") / 2).alias("bx"), F.floor(F.col("gy") / 2).alias("by_")).agg(F.avg("v").alias("m")).groupBy(*by).agg(F.var_pop("m").alias("blocks"))
    return total.join(blocks, list(by)).select(*by, "total", ((F.col("dr") + F.col("dd")) / (F.col("nr") + F.col("nd"))).alias("difference_energy"), F.when(F.col("total") > 0, F.col("blocks") / F.col("total")).alias("block_share"))


def component_summary(points: DataFrame, component: str, *by: str) -> DataFrame:
    """Cells of each component, the largest one's share, and whether to report both pooled and apart."""
    c = points.groupBy(*by, component).agg(F.count(F.lit(1)).alias("k"))
    out = c.groupBy(*by).agg(F.count(F.lit(1)).alias("components"), (F.max("k") / F.sum("k")).alias("largest_share"))
    return out.withColumn("mode", F.when(F.col("largest_share") < 0.8, "both").otherwise("pooled"))


def joint_information(rows: DataFrame, variables: Sequence[str], *by: str) -> DataFrame:
    """Plug-in entropies in bits of every non-empty subset, and the co-information of all variables."""
    from itertools import combinations

    out = None
    for size in range(1, len(variables) + 1):
        for some in combinations(variables, size):
            counts = rows.groupBy(*by, *some).agg(F.count(F.lit(1)).alias("k"))
            n = F.sum("k").over(Window.partitionBy(*by))
            p = counts.withColumn("p", F.col("k") / n).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
            p = p.select(*by, F.lit("+".join(some)).alias("ensemble"), F.lit(size).alias("size"), "entropy")
            out = p if out is None else out.union(p)
    whole = out.groupBy(*by).agg(F.sum(F.when(F.col("size") % 2 == 1, F.col("entropy")).otherwise(-F.col("entropy"))).alias("co_information"))
    return out.join(whole, list(by)) if by else out.crossJoin(whole)


def redundancy(rows: DataFrame, target: str, first: str, second: str, *by: str) -> DataFrame:
    """Williams-Beer decomposition in bits of what two sources say about a target."""
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    pt = rows.groupBy(*by, target).agg(F.count(F.lit(1)).alias("kt"))

    def specific(sources: Sequence[str], name: str) -> DataFrame:
        joint = rows.groupBy(*by, target, *sources).agg(F.count(F.lit(1)).alias("k"))
        ps = rows.groupBy(*by, *sources).agg(F.count(F.lit(1)).alias("ks"))
        j = joint.join(ps, [*by, *sources]).join(pt, [*by, target]).join(n, list(by))
        term = F.col("k") / F.col("kt") * F.log2(F.col("k") / F.col("ks") / (F.col("kt") / F.col("n")))
        return j.groupBy(*by, target).agg(F.sum(term).alias(name))

    s = specific([first], "i1").join(specific([second], "i2"), [*by, target]).join(specific([first, second], "i12"), [*by, target]).join(pt, [*by, target]).join(n, list(by))
    w = F.col("kt") / F.col("n")
    out = s.groupBy(*by).agg(F.sum(w * F.least("i1", "i2")).alias("shared"), F.sum(w * F.col("i1")).alias("m1"), F.sum(w * F.col("i2")).alias("m2"), F.sum(w * F.col("i12")).alias("m12"))
    return out.select(*by, "shared", (F.col("m1") - F.col("shared")).alias("unique_first"), (F.col("m2") - F.col("shared")).alias("unique_second"), (F.col("m12") - F.col("m1") - F.col("m2") + F.col("shared")).alias("synergy"))


def diversity(points: DataFrame, label: str, *by: str) -> DataFrame:
    """Within-unit (alpha), pooled (gamma) and between-unit (beta) Shannon diversity, units weighted by size."""
    k = points.groupBy(*by, label).agg(F.count(F.lit(1)).alias("k"))
    unit = k.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("s")).withColumn("h", F.log("n") - F.col("s") / F.col("n"))
    alpha = unit.agg((F.sum(F.col("n") * F.col("h")) / F.sum("n")).alias("alpha"))
    pooled = k.groupBy(label).agg(F.sum("k").alias("k")).agg((F.log(F.sum("k")) - F.sum(F.col("k") * F.log("k")) / F.sum("k")).alias("gamma"))
    return alpha.crossJoin(pooled).withColumn("beta", F.col("gamma") - F.col("alpha"))


def binned_spectrum(peaks: DataFrame, width: float, axis: str, intensity: str, *by: str) -> DataFrame:
    """Summed and square-root-scaled intensity per fixed bin, with the bin's share of the total."""
    bins = peaks.groupBy(*by, F.floor(F.col(axis) / float(width)).cast("long").alias("bin")).agg(F.sum(intensity).alias("total"), F.sum(F.sqrt(intensity)).alias("root"), F.count(F.lit(1)).alias("n"))
    return bins.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy(*by)))


def codebook(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Dense codes of a column's levels, in the order of their first rows; null and blank have none.

    The window runs over levels, one row each, not over rows.
    """
    firsts = rows.where(F.trim(column) != "").groupBy(F.col(column).alias("level")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    return firsts.select("level", (F.row_number().over(Window.orderBy("first", "level")) - 1).alias("code"), "n")


def matched(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One-to-one join by identity: repeated or missing keys, on either side, are errors."""
    one = lambda df, n: df.groupBy(*on).agg(F.count(F.lit(1)).alias(n))
    bad = F.raise_error(F.concat(F.lit("no single match for "), F.to_json(F.struct(*on)))).cast("boolean")
    counts = one(left, "_l").join(one(right, "_r"), list(on), "full")
    counts = counts.where(F.when(F.coalesce(F.col("_l") == 1, F.lit(False)) & F.coalesce(F.col("_r") == 1, F.lit(False)), True).otherwise(bad)).select(*on)
    return counts.join(left, list(on)).join(right, list(on))


def contained(points: DataFrame, boxes: DataFrame, width: float) -> DataFrame:
    """Points in half-open boxes(pattern_id, box, x0, y0, x1, y1): pattern_id, idx, box.

    Boxes are copied to the squares of `width` that they touch; a point meets those of its own.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    own = points.select("pattern_id", "idx", "x", "y", cell("x").alias("gx"), cell("y").alias("gy"))
    to = boxes.select("*", F.explode(F.sequence(cell("x0"), cell("x1"))).alias("gx")).select("*", F.explode(F.sequence(cell("y0"), cell("y1"))).alias("gy"))
    met = own.join(to.hint("merge"), ["pattern_id", "gx", "gy"]).where("x >= x0 and x < x1 and y >= y0 and y < y1")
    return met.select("pattern_id", "idx", "box")


def rolling_mean(curves: DataFrame, width: int, key: str, order: str, value: str) -> DataFrame:
    """Centred mean over `width` (odd) neighbouring rows; null where the frame isn't full."""
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(-(width // 2), width // 2)
    return curves.withColumn("rolled", F.when(F.count(value).over(frame) == width, F.avg(value).over(frame)))


def preprocessed_spectrum(peaks: DataFrame, low: float, high: float, axis: str, intensity: str, by: str) -> DataFrame:
    """Trimmed to [low, high), square-rooted, smoothed by a quadratic over five points, divided by the total.

    Where a spectrum's ends have no five points the root stays; negative results become zero.
    """
    w = Window.partitionBy(by).orderBy(axis)
    at = lambda k: F.lag("root", k).over(w)
    rows = peaks.where((F.col(axis) >= low) & (F.col(axis) < high)).withColumn("root", F.sqrt(F.greatest(F.col(intensity), F.lit(0.0))))
    smooth = (-3 * at(2) + 12 * at(1) + 17 * F.col("root") + 12 * at(-1) - 3 * at(-2)) / 35
    rows = rows.withColumn("smooth", F.greatest(F.lit(0.0), F.coalesce(smooth, F.col("root"))))
    total = rows.groupBy(by).agg(F.sum("smooth").alias("total"))
    return rows.join(total, by).select(by, axis, (F.col("smooth") / F.nullif("total", F.lit(0.0))).alias("intensity"))


def unit_divergence(rows: DataFrame, unit: str, variables: Sequence[str], alpha: float) -> DataFrame:
    """Divergence (bits) of each unit's joint distribution from the pooled one, cells smoothed by alpha.

    Cells are those that any unit has. What the cells that a unit lacks add depends on the pooled
    shares' sum of logarithms only, so units never meet cells that they don't have.
    """
    k = rows.groupBy(unit, *variables).agg(F.count(F.lit(1)).alias("k"))
    pooled = k.groupBy(*variables).agg(F.sum("k").alias("pk"))
    size = pooled.agg(F.sum("pk").alias("pn"), F.count(F.lit(1)).alias("cells"))
    q = (F.col("pk") + float(alpha)) / (F.col("pn") + float(alpha) * F.col("cells"))
    pooled = pooled.join(F.broadcast(size)).select(*variables, "cells", F.log2(q).alias("lq"))
    logs = pooled.agg(F.sum("lq").alias("all_lq"))
    n = k.groupBy(unit).agg(F.sum("k").alias("n"))
    have = k.join(pooled, list(variables)).join(n, unit)
    whole = F.col("n") + float(alpha) * F.col("cells")
    p = (F.col("k") + float(alpha)) / whole
    u = have.groupBy(unit).agg(F.max("n").alias("n"), F.max("cells").alias("cells"), F.count(F.lit(1)).alias("has"), F.sum(p * (F.log2(p) - F.col("lq"))).alias("own"), F.sum("lq").alias("own_lq"))
    rest = F.lit(float(alpha)) / whole
    missing = rest * ((F.col("cells") - F.col("has")) * F.log2(rest) - (F.col("all_lq") - F.col("own_lq"))) if alpha else F.lit(0.0)
    return u.join(F.broadcast(logs)).select(unit, "n", (F.col("own") + missing).alias("divergence"))
