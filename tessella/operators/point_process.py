"""Summary functions of point patterns in rectangular windows.

Every function takes points (pattern_id, idx, x, y, marks) and returns one row per pattern and
radius, shell or bin; a value that the data can't support is null, never zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import area, boundary_distance, levels, nearest_any, on_all, pairs

Rect = tuple[float, float, float, float]


def _at_radii(points: DataFrame, met: DataFrame, radii: Sequence[float]) -> DataFrame:
    """met with each pair at every radius that holds it."""
    r = F.explode(F.array(*[F.lit(float(x)) for x in radii])).alias("r")
    return met.select("*", r).where(F.col("d2") <= F.col("r") * F.col("r"))


def _eligible(points: DataFrame, radii: Sequence[float], window: Rect, margin: float = 0.0, *more: Column) -> DataFrame:
    """Centres whose disc of radius r (and margin) lies in the window, for each radius."""
    b, n = boundary_distance(window), F.count(F.lit(1))
    cols = [F.count(F.when(b >= float(r) + margin, 1)).alias(f"e{k}") for k, r in enumerate(radii)]
    wide = points.groupBy("pattern_id").agg(n.alias("n"), *more, *cols)
    each = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("r"), F.col(f"e{k}").alias("eligible")) for k, r in enumerate(radii)]))
    extra = [c for c in wide.columns if not (c[0] == "e" and c[1:].isdigit())]
    return wide.select(*extra, each.alias("v")).select(*extra, "v.r", "v.eligible")


def border_k(points: DataFrame, radii: Sequence[float], window: Rect) -> DataFrame:
    """Border-corrected K and L: ordered pairs of eligible centres, area * pairs / (n * eligible)."""
    met = _at_radii(points, pairs(points, None, max(radii)), radii)
    counts = met.where(F.col("r") <= boundary_distance(window, "i_x", "i_y")).groupBy("pattern_id", "r").agg(F.count(F.lit(1)).alias("pairs"))
    out = _eligible(points, radii, window).join(counts, ["pattern_id", "r"], "left").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    k = F.when((F.col("eligible") > 0) & (F.col("n") > 1), area(window) * F.col("pairs") / (F.col("n") * F.col("eligible")))
    return out.withColumn("k", k).withColumn("l", F.sqrt(F.col("k") / F.pi()))


def border_g(points: DataFrame, radii: Sequence[float], bandwidth: float, window: Rect) -> DataFrame:
    """Pair correlation with an open Epanechnikov kernel; centres eligible at r + bandwidth."""
    h = float(bandwidth)
    met = pairs(points, None, max(radii) + h).withColumn("d", F.sqrt("d2"))
    met = met.select("*", F.explode(F.array(*[F.lit(float(x)) for x in radii])).alias("r")).where((F.abs(F.col("r") - F.col("d")) < h) & (F.col("r") + h <= boundary_distance(window, "i_x", "i_y")))
    u = (F.col("r") - F.col("d")) / h
    sums = met.groupBy("pattern_id", "r").agg(F.sum(0.75 * (1 - u * u) / h).alias("weight"), F.count(F.lit(1)).alias("pairs"))
    out = _eligible(points, radii, window, h).join(sums, ["pattern_id", "r"], "left")
    g = area(window) * F.coalesce("weight", F.lit(0.0)) / (2 * F.pi() * F.col("r") * F.col("n") * F.col("eligible"))
    return out.select("pattern_id", "r", "n", "eligible", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when((F.col("eligible") > 0) & (F.col("n") > 1), g).alias("g"))


def _overlap(window: Rect) -> Column:
    """Area that the window shares with itself moved by the pair's displacement."""
    x0, y0, x1, y1 = map(float, window)
    return F.greatest(F.lit(0.0), x1 - x0 - F.abs(F.col("i_x") - F.col("j_x"))) * F.greatest(F.lit(0.0), y1 - y0 - F.abs(F.col("i_y") - F.col("j_y")))


def translation_k(points: DataFrame, radii: Sequence[float], window: Rect) -> DataFrame:
    """Translation-corrected K and L: unordered pairs weighted by 2 * area / overlap."""
    met = pairs(points, None, max(radii), unordered=True).withColumn("w", 2 * area(window) / _overlap(window))
    sums = _at_radii(points, met, radii).groupBy("pattern_id", "r").agg(F.sum("w").alias("weight"))
    n = points.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    out = on_all(sums, n.select("pattern_id"), levels(points, r=[float(r) for r in radii]), ["r"]).join(n, "pattern_id")
    k = F.when(F.col("n") > 1, area(window) * F.coalesce("weight", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1)))
    return out.select("pattern_id", "r", "n", k.alias("k")).withColumn("l", F.sqrt(F.col("k") / F.pi()))


def translation_g(points: DataFrame, radii: Sequence[float], bandwidth: float, window: Rect) -> DataFrame:
    """Translation-corrected pair correlation."""
    h = float(bandwidth)
    met = pairs(points, None, max(radii) + h, unordered=True).withColumn("w", 2 * area(window) / _overlap(window)).withColumn("d", F.sqrt("d2"))
    met = met.select("*", F.explode(F.array(*[F.lit(float(x)) for x in radii])).alias("r")).where(F.abs(F.col("r") - F.col("d")) < h)
    u = (F.col("r") - F.col("d")) / h
    sums = met.groupBy("pattern_id", "r").agg(F.sum(F.col("w") * 0.75 * (1 - u * u) / h).alias("weight"))
    n = points.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    out = on_all(sums, n.select("pattern_id"), levels(points, r=[float(r) for r in radii]), ["r"]).join(n, "pattern_id")
    g = area(window) * F.coalesce("weight", F.lit(0.0)) / (2 * F.pi() * F.col("r") * F.col("n") * (F.col("n") - 1))
    return out.select("pattern_id", "r", "n", F.when(F.col("n") > 1, g).alias("g"))


def nearest_space(points: DataFrame, radii: Sequence[float], grid: int, window: Rect, epsilon: float = 1e-12) -> DataFrame:
    """Reduced-sample G, F and J; F from a fixed grid of cell-centred probes."""
    x0, y0, x1, y1 = map(float, window)
    top = max(radii)
    own = points.select("pattern_id", "idx", "x", "y")
    step = F.explode(F.sequence(F.lit(0), F.lit(grid * grid - 1))).alias("idx")
    probes = own.select("pattern_id").distinct().select("pattern_id", step)
    probes = probes.select("pattern_id", F.col("idx").cast("long"), (x0 + (F.col("idx") % grid + 0.5) * ((x1 - x0) / grid)).alias("x"), (y0 + (F.floor(F.col("idx") / grid) + 0.5) * ((y1 - y0) / grid)).alias("y"))

    def cdf(who: DataFrame, met: DataFrame, name: str) -> DataFrame:
        near = met.groupBy("pattern_id", F.col("i").alias("idx")).agg(F.min("d2").alias("d2"))
        joined = who.join(near, ["pattern_id", "idx"], "left").withColumn("b", boundary_distance(window))
        each = joined.select("pattern_id", "d2", "b", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("r")).where("b >= r")
        hit = F.count(F.when(F.col("d2") <= F.col("r") * F.col("r"), 1))
        return each.groupBy("pattern_id", "r").agg((hit / F.count(F.lit(1))).alias(name))

    g = cdf(own, pairs(own, None, top), "g")
    f = cdf(probes, pairs(probes, own, top), "f")
    out = on_all(g, own.select("pattern_id").distinct(), levels(points, r=[float(r) for r in radii]), ["r"]).join(f, ["pattern_id", "r"], "left")
    return out.select("pattern_id", "r", "g", "f", F.when(1 - F.col("f") > epsilon, (1 - F.col("g")) / (1 - F.col("f"))).alias("j"))


def cross_k(points: DataFrame, source: str, target: str, radii: Sequence[float], window: Rect) -> DataFrame:
    """Directed cross-K from one label to another: area * pairs / (eligible sources * targets)."""
    a, b = points.where(F.col("label") == source), points.where(F.col("label") == target)
    met = pairs(a, b, max(radii)).where("i <> j")
    counts = _at_radii(points, met, radii).where(F.col("r") <= boundary_distance(window, "i_x", "i_y")).groupBy("pattern_id", "r").agg(F.count(F.lit(1)).alias("pairs"))
    targets = b.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("targets"))
    out = _eligible(a, radii, window).withColumnRenamed("n", "sources").join(targets, "pattern_id").join(counts, ["pattern_id", "r"], "left")
    k = area(window) * F.coalesce("pairs", F.lit(0)) / (F.col("eligible") * F.col("targets"))
    return out.select("pattern_id", "r", "sources", "targets", "eligible", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when(F.col("eligible") > 0, k).alias("cross_k"))


def shells(radii: Sequence[float], d2: str = "d2") -> Column:
    """The first radius at or above the distance; shells are (before, radius], the first from 0."""
    out = F.lit(None).cast("double")
    for r in sorted(map(float, radii), reverse=True):
        out = F.when(F.col(d2) <= r * r, F.lit(r)).otherwise(out)
    return out


def mark_connection(points: DataFrame, radii: Sequence[float], window: Rect) -> DataFrame:
    """Share of each ordered label pair among the pairs of a shell whose centre is eligible."""
    met = pairs(points, None, max(radii), ["label"]).withColumn("r", shells(radii))
    met = met.where(F.col("r") <= boundary_distance(window, "i_x", "i_y"))
    counts = met.groupBy("pattern_id", "r", F.col("i_label").alias("source"), F.col("j_label").alias("target")).agg(F.count(F.lit(1)).alias("pairs"))
    total = counts.groupBy("pattern_id", "r").agg(F.sum("pairs").alias("total"))
    return counts.join(total, ["pattern_id", "r"]).withColumn("connection", F.col("pairs") / F.col("total"))


def mark_correlation(points: DataFrame, radii: Sequence[float], window: Rect, value: str = "value") -> DataFrame:
    """Mean product of a shell's marks over the squared mean mark; needs a varying mark."""
    met = pairs(points, None, max(radii), [value]).withColumn("r", shells(radii)).where(F.col("r") <= boundary_distance(window, "i_x", "i_y"))
    sums = met.groupBy("pattern_id", "r").agg(F.avg(F.col(f"i_{value}") * F.col(f"j_{value}")).alias("product"), F.count(F.lit(1)).alias("pairs"))
    means = points.groupBy("pattern_id").agg(F.avg(value).alias("mean"), F.var_pop(value).alias("variance"))
    out = on_all(sums, means.select("pattern_id"), levels(points, r=[float(r) for r in radii]), ["r"]).join(means, "pattern_id")
    return out.select("pattern_id", "r", F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when(F.col("variance") > 0, F.col("product") / (F.col("mean") * F.col("mean"))).alias("correlation"))


def mark_weighted_k(points: DataFrame, radii: Sequence[float], window: Rect, value: str = "value") -> DataFrame:
    """K with each pair weighted by its marks' product over the squared mean."""
    met = _at_radii(points, pairs(points, None, max(radii), [value]), radii).where(F.col("r") <= boundary_distance(window, "i_x", "i_y"))
    sums = met.groupBy("pattern_id", "r").agg(F.sum(F.col(f"i_{value}") * F.col(f"j_{value}")).alias("product"))
    out = _eligible(points, radii, window, 0.0, F.avg(value).alias("mean")).join(sums, ["pattern_id", "r"], "left")
    k = area(window) * F.coalesce("product", F.lit(0.0)) / (F.col("mean") * F.col("mean")) / (F.col("n") * F.col("eligible"))
    return out.select("pattern_id", "r", "eligible", F.when(F.col("eligible") > 0, k).alias("weighted_k"))


def probability_connection(points: DataFrame, radii: Sequence[float], p: str = "probability") -> DataFrame:
    """Mean product of soft memberships per shell, with its expectation under random labelling."""
    met = pairs(points, None, max(radii), [p]).withColumn("r", shells(radii))
    sums = met.groupBy("pattern_id", "r").agg(F.avg(F.col(f"i_{p}") * F.col(f"j_{p}")).alias("connection"), F.count(F.lit(1)).alias("pairs"))
    s = points.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(F.col(p) * F.col(p)).alias("ss"))
    return sums.join(s, "pattern_id").select("pattern_id", "r", "pairs", "connection", ((F.col("s") * F.col("s") - F.col("ss")) / (F.col("n") * (F.col("n") - 1))).alias("expected"))


def semivariogram(points: DataFrame, edges: Sequence[float], value: str = "value") -> DataFrame:
    """Mean of half the squared difference per lag bin [lo, hi), the last one closed."""
    met = pairs(points, None, max(edges), [value], unordered=True)
    spans = list(zip(edges, edges[1:]))
    bin_ = F.lit(None).cast("int")
    for k, (lo, hi) in reversed(list(enumerate(spans))):
        inside = (F.col("d2") >= float(lo) ** 2) & ((F.col("d2") <= float(hi) ** 2) if k == len(spans) - 1 else (F.col("d2") < float(hi) ** 2))
        bin_ = F.when(inside, F.lit(k)).otherwise(bin_)
    d = F.col(f"i_{value}") - F.col(f"j_{value}")
    sums = met.withColumn("bin", bin_).where("bin is not null").groupBy("pattern_id", "bin").agg(F.avg(0.5 * d * d).alias("gamma"), F.count(F.lit(1)).alias("pairs"))
    out = on_all(sums, points.select("pattern_id").distinct(), levels(points, bin=list(range(len(spans))), lo=[float(a) for a, _ in spans], hi=[float(b) for _, b in spans]), ["bin"])
    return out.select("pattern_id", "lo", "hi", F.coalesce("pairs", F.lit(0)).alias("pairs"), "gamma")


def mark_pair_covariance(points: DataFrame, width: float, top: float, mark: str = "mark") -> DataFrame:
    """Mean product of centred binary marks per half-open distance bin; d < top."""
    import math

    bins = math.ceil(top / width)
    met = pairs(points, None, top, [mark], unordered=True).where(F.col("d2") < float(top) ** 2).withColumn("bin", F.floor(F.sqrt("d2") / float(width)).cast("int"))
    share = points.groupBy("pattern_id").agg(F.avg(mark).alias("p"))
    sums = met.groupBy("pattern_id", "bin").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.col(f"i_{mark}") * F.col(f"j_{mark}")).alias("both"), F.sum(F.col(f"i_{mark}") + F.col(f"j_{mark}")).alias("either"))
    out = on_all(sums, share.select("pattern_id"), levels(points, bin=list(range(bins))), ["bin"]).join(share, "pattern_id")
    cov = (F.col("both") - F.col("p") * F.col("either")) / F.col("pairs") + F.col("p") * F.col("p")
    return out.select("pattern_id", F.col("bin").cast("int"), (F.col("bin") * float(width)).alias("r_min"), F.coalesce("pairs", F.lit(0)).alias("pair_count"), cov.alias("covariance"))


def _weighted(points: DataFrame, radius: float, value: str) -> DataFrame:
    z = points.groupBy("pattern_id").agg(F.avg(value).alias("mean"), F.sum(F.col(value) * F.col(value)).alias("sq"), F.count(F.lit(1)).alias("n"))
    return z.withColumn("ss", F.col("sq") - F.col("n") * F.col("mean") * F.col("mean"))


def moran(points: DataFrame, radius: float, value: str = "value") -> DataFrame:
    """Global Moran's I with binary weights; null without edges or variance."""
    met = pairs(points, None, radius, [value]).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col(f"i_{value}") * F.col(f"j_{value}")).alias("cross"), F.sum(f"i_{value}").alias("si"))
    out = _weighted(points, radius, value).join(met, "pattern_id", "left")
    num = F.col("cross") - 2 * F.col("mean") * F.col("si") + F.col("edges") * F.col("mean") * F.col("mean")
    return out.select("pattern_id", "n", F.coalesce("edges", F.lit(0)).alias("edges"), F.when((F.col("edges") > 0) & (F.col("ss") > 0), F.col("n") / F.col("edges") * num / F.col("ss")).alias("moran_i"))


def geary(points: DataFrame, radius: float, value: str = "value") -> DataFrame:
    """Global Geary's C with binary weights."""
    d = F.col(f"i_{value}") - F.col(f"j_{value}")
    met = pairs(points, None, radius, [value]).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(d * d).alias("diff"))
    out = _weighted(points, radius, value).join(met, "pattern_id", "left")
    return out.select("pattern_id", "n", F.coalesce("edges", F.lit(0)).alias("edges"), F.when((F.col("edges") > 0) & (F.col("ss") > 0), (F.col("n") - 1) / (2 * F.col("edges")) * F.col("diff") / F.col("ss")).alias("geary_c"))


def local_moran(points: DataFrame, radius: float, value: str = "value") -> DataFrame:
    """Per point: z times the mean z of its neighbours, and the quadrant of both signs."""
    stats = points.groupBy("pattern_id").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    lag = pairs(points, None, radius, [value]).groupBy("pattern_id", F.col("i").alias("idx"), F.col(f"i_{value}").alias("v")).agg(F.avg(f"j_{value}").alias("near"), F.count(F.lit(1)).alias("neighbours"))
    out = lag.join(stats, "pattern_id").where("sd > 0").withColumn("z", (F.col("v") - F.col("mean")) / F.col("sd")).withColumn("lag", (F.col("near") - F.col("mean")) / F.col("sd"))
    side = lambda c: F.when(F.col(c) >= 0, "high").otherwise("low")
    return out.select("pattern_id", "idx", "neighbours", (F.col("z") * F.col("lag")).alias("local_i"), F.concat_ws("_", side("z"), side("lag")).alias("quadrant"))


def inhomogeneous_k(points: DataFrame, intensity: Column, radii: Sequence[float], window: Rect) -> DataFrame:
    """K with each eligible centre's pairs weighted by reciprocal intensities."""
    rich = points.withColumn("lam", intensity)
    met = _at_radii(rich, pairs(rich, None, max(radii), ["lam"]), radii).where(F.col("r") <= boundary_distance(window, "i_x", "i_y"))
    top = met.groupBy("pattern_id", "r").agg(F.sum(1 / (F.col("i_lam") * F.col("j_lam"))).alias("top"))
    each = rich.withColumn("b", boundary_distance(window)).select("pattern_id", "b", "lam", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("r")).where("b >= r")
    low = each.groupBy("pattern_id", "r").agg(F.sum(1 / F.col("lam")).alias("low"))
    return low.join(top, ["pattern_id", "r"], "left").select("pattern_id", "r", (F.coalesce("top", F.lit(0.0)) / F.col("low")).alias("k"))


def loo_intensity(points: DataFrame, bandwidth: float, reach: float) -> DataFrame:
    """Leave-one-out truncated Gaussian intensity at each point, without edge mass."""
    h2 = 2 * float(bandwidth) ** 2
    sums = pairs(points, None, reach).groupBy("pattern_id", F.col("i").alias("idx")).agg(F.sum(F.exp(-F.col("d2") / h2)).alias("s"))
    return points.select("pattern_id", "idx").join(sums, ["pattern_id", "idx"], "left").select("pattern_id", "idx", (F.coalesce("s", F.lit(0.0)) / (F.pi() * h2)).alias("intensity"))


def landy_szalay(points: DataFrame, random: DataFrame, edges: Sequence[float]) -> DataFrame:
    """(DD - 2 DR + RR) / RR per bin [lo, hi), each normalised by its number of pairs."""
    top, spans = max(edges), list(zip(edges, edges[1:]))
    bin_ = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(spans):
        bin_ = F.when((F.col("d2") >= float(lo) ** 2) & (F.col("d2") < float(hi) ** 2), F.lit(k)).otherwise(bin_)
    def count(met: DataFrame, name: str) -> DataFrame:
        return met.withColumn("bin", bin_).where("bin is not null").groupBy("pattern_id", "bin").agg(F.count(F.lit(1)).alias(name))

    n, m = (df.groupBy("pattern_id").agg(F.count(F.lit(1)).alias(c)) for df, c in ((points, "n"), (random, "m")))
    out = on_all(count(pairs(points, None, top, unordered=True), "dd"), n.select("pattern_id"), levels(points, bin=list(range(len(spans)))), ["bin"])
    out = out.join(count(pairs(points, random, top), "dr"), ["pattern_id", "bin"], "left").join(count(pairs(random, None, top, unordered=True), "rr"), ["pattern_id", "bin"], "left").join(n, "pattern_id").join(m, "pattern_id")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    dd, dr, rr = z("dd") / (F.col("n") * (F.col("n") - 1) / 2), z("dr") / (F.col("n") * F.col("m")), z("rr") / (F.col("m") * (F.col("m") - 1) / 2)
    return out.select("pattern_id", F.col("bin").cast("int"), z("dd").alias("dd"), z("dr").alias("dr"), z("rr").alias("rr"), F.when(z("rr") > 0, (dd - 2 * dr + rr) / rr).alias("xi"))


def mean_nearest(points: DataFrame, reach: float) -> DataFrame:
    """Mean distance to the nearest neighbour; reach is where the search starts."""
    near = nearest_any(points.select("pattern_id", "idx", "x", "y"), None, reach)
    return near.groupBy("pattern_id").agg(F.avg(F.sqrt("d2")).alias("mean_distance"), F.count(F.lit(1)).alias("points"))


def _inside(window: Rect, x: str, y: str, d: str = "d") -> Column:
    """Share of the circle of radius d around a point that lies in the window; 1 for d = 0.

    Each side cuts off an arc; two arcs that meet beyond a corner share part of it. Right for
    radii up to half the shorter side, where opposite sides' arcs can't meet.
    """
    x0, y0, x1, y1 = map(float, window)
    arc = lambda gap: F.acos(F.least(F.lit(1.0), gap / F.nullif(F.col(d), F.lit(0.0))))
    across, along = [arc(F.col(x) - x0), arc(x1 - F.col(x))], [arc(F.col(y) - y0), arc(y1 - F.col(y))]
    out = 2 * (across[0] + across[1] + along[0] + along[1])
    for a in across:
        for b in along:
            out = out - F.greatest(F.lit(0.0), a + b - F.pi() / 2)
    return 1 - out / (2 * F.pi())


def _isotropic(points: DataFrame, reach: float, window: Rect) -> DataFrame:
    if 2 * reach > min(window[2] - window[0], window[3] - window[1]):
        raise ValueError("radii must not exceed half the window's shorter side")
    met = pairs(points, None, reach, unordered=True).withColumn("d", F.sqrt("d2"))
    return met.withColumn("w", 1 / _inside(window, "i_x", "i_y") + 1 / _inside(window, "j_x", "j_y"))


def isotropic_k(points: DataFrame, radii: Sequence[float], window: Rect) -> DataFrame:
    """K and L with each pair weighted by the inverse shares of its two circles in the window."""
    sums = _at_radii(points, _isotropic(points, max(radii), window), radii).groupBy("pattern_id", "r").agg(F.sum("w").alias("weight"))
    n = points.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    out = on_all(sums, n.select("pattern_id"), levels(points, r=[float(r) for r in radii]), ["r"]).join(n, "pattern_id")
    k = F.when(F.col("n") > 1, area(window) * F.coalesce("weight", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1)))
    return out.select("pattern_id", "r", "n", k.alias("k")).withColumn("l", F.sqrt(F.col("k") / F.pi()))


def _kernel(met: DataFrame, radii: Sequence[float], h: float) -> DataFrame:
    """met at each radius whose open Epanechnikov kernel holds the pair, with the kernel's value e."""
    at = met.select("*", F.explode(F.array(*[F.lit(float(x)) for x in radii])).alias("r")).where(F.abs(F.col("r") - F.col("d")) < h)
    u = (F.col("r") - F.col("d")) / h
    return at.withColumn("e", 0.75 * (1 - u * u) / h)


def isotropic_g(points: DataFrame, radii: Sequence[float], bandwidth: float, window: Rect) -> DataFrame:
    """Pair correlation with the isotropic weights."""
    h = float(bandwidth)
    sums = _kernel(_isotropic(points, max(radii) + h, window), radii, h).groupBy("pattern_id", "r").agg(F.sum(F.col("e") * F.col("w")).alias("weight"))
    n = points.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    out = on_all(sums, n.select("pattern_id"), levels(points, r=[float(r) for r in radii]), ["r"]).join(n, "pattern_id")
    g = area(window) * F.coalesce("weight", F.lit(0.0)) / (2 * F.pi() * F.col("r") * F.col("n") * (F.col("n") - 1))
    return out.select("pattern_id", "r", "n", F.when(F.col("n") > 1, g).alias("g"))


def cross_g(points: DataFrame, source: str, target: str, radii: Sequence[float], bandwidth: float, window: Rect) -> DataFrame:
    """Border-corrected pair correlation from one label to another; sources eligible at r + bandwidth."""
    h, own, other = float(bandwidth), points.where(F.col("label") == source), points.where(F.col("label") == target)
    met = _kernel(pairs(own, other, max(radii) + h).withColumn("d", F.sqrt("d2")), radii, h)
    sums = met.where(F.col("r") + h <= boundary_distance(window, "i_x", "i_y")).groupBy("pattern_id", "r").agg(F.sum("e").alias("weight"))
    targets = other.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("targets"))
    out = _eligible(own, radii, window, h).join(targets, "pattern_id").join(sums, ["pattern_id", "r"], "left")
    g = area(window) * F.coalesce("weight", F.lit(0.0)) / (2 * F.pi() * F.col("r") * F.col("targets") * F.col("eligible"))
    return out.select("pattern_id", "r", F.col("n").alias("sources"), "targets", "eligible", F.when(F.col("eligible") > 0, g).alias("g"))


def inhomogeneous_g(points: DataFrame, intensity: Column, radii: Sequence[float], bandwidth: float, window: Rect) -> DataFrame:
    """Pair correlation of a pattern whose intensity varies; pairs count 1 / (intensity_i * intensity_j)."""
    h, rich = float(bandwidth), points.withColumn("lam", intensity)
    met = _kernel(pairs(rich, None, max(radii) + h, ["lam"]).withColumn("d", F.sqrt("d2")), radii, h)
    top = met.where(F.col("r") + h <= boundary_distance(window, "i_x", "i_y")).groupBy("pattern_id", "r").agg(F.sum(F.col("e") / (F.col("i_lam") * F.col("j_lam"))).alias("top"))
    b = boundary_distance(window)
    low = rich.select("pattern_id", "lam", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("r"), b.alias("b")).where(F.col("r") + h <= F.col("b"))
    low = low.groupBy("pattern_id", "r").agg(F.sum(1 / F.col("lam")).alias("low"))
    return low.join(top, ["pattern_id", "r"], "left").select("pattern_id", "r", (F.coalesce("top", F.lit(0.0)) / F.col("low") / (2 * F.pi() * F.col("r"))).alias("g"))


def bandwidth_selection(points: DataFrame, bandwidths: Sequence[float], reach: float, least: float = 1e-12) -> DataFrame:
    """Mean log leave-one-out intensity of each Gaussian bandwidth; the first best one is selected.

    Events with no other within reach count as intensity `least`.
    """
    met = pairs(points, None, reach)
    sums = [F.sum(F.exp(-F.col("d2") / (2.0 * float(h) ** 2))).alias(f"s{k}") for k, h in enumerate(bandwidths)]
    at = points.select("pattern_id", "idx").join(met.groupBy("pattern_id", F.col("i").alias("idx")).agg(*sums), ["pattern_id", "idx"], "left")
    each = F.explode(F.array(*[F.struct(F.lit(float(h)).alias("bandwidth"), (F.coalesce(f"s{k}", F.lit(0.0)) / (2 * F.pi() * float(h) ** 2)).alias("lam")) for k, h in enumerate(bandwidths)]))
    score = at.select("pattern_id", each.alias("v")).groupBy("pattern_id", "v.bandwidth").agg(F.avg(F.log(F.greatest(F.col("v.lam"), F.lit(float(least))))).alias("score"))
    best = score.groupBy("pattern_id").agg(F.max(F.struct("score", F.negative("bandwidth").alias("o"))).alias("best"))
    return score.join(best, "pattern_id").select("pattern_id", "bandwidth", "score", (F.col("bandwidth") == -F.col("best.o")).alias("selected"))


def poisson_log_likelihood(points: DataFrame, log_intensity: Column, window: Rect, grid: int) -> DataFrame:
    """Sum of the events' log intensities less the intensity's integral over midpoints of a grid."""
    x0, y0, x1, y1 = map(float, window)
    dx, dy, n = (x1 - x0) / grid, (y1 - y0) / grid, F.col("id")
    nodes = points.sparkSession.range(grid * grid).select((x0 + (n % grid + 0.5) * dx).alias("x"), (y0 + (F.floor(n / grid) + 0.5) * dy).alias("y"))
    integral = nodes.agg((F.sum(F.exp(log_intensity)) * dx * dy).alias("integral"))
    events = points.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.sum(log_intensity).alias("events"))
    return events.join(F.broadcast(integral)).select("pattern_id", "n", "events", "integral", (F.col("events") - F.col("integral")).alias("log_likelihood"))


def conditional_intensity(points: DataFrame, radius: float, log_beta: float, log_gamma: float) -> DataFrame:
    """Log conditional intensity of a pairwise-interaction process at each event, given the others."""
    near = pairs(points, None, radius).groupBy("pattern_id", F.col("i").alias("idx")).agg(F.count(F.lit(1)).alias("t"))
    out = points.select("pattern_id", "idx").join(near, ["pattern_id", "idx"], "left").select("pattern_id", "idx", F.coalesce("t", F.lit(0)).alias("neighbours"))
    return out.withColumn("log_intensity", log_beta + log_gamma * F.col("neighbours"))


def minimum_contrast(curves: DataFrame, densities: Sequence[float], scales: Sequence[float], power: float = 0.25) -> DataFrame:
    """Cluster process fitted to K curves (pattern_id, r, k): parent density and scale of least contrast.

    The contrast is the sum over radii of (observed^power - model^power)^2, over a parameter grid;
    ties keep the smallest density, then scale.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("density"), F.lit(float(s)).alias("scale")) for a in densities for s in scales]))
    model = F.pi() * F.col("r") * F.col("r") + (1 - F.exp(-F.col("r") * F.col("r") / (4 * F.col("g.scale") * F.col("g.scale")))) / F.col("g.density")
    gap = F.pow("k", F.lit(power)) - F.pow(model, F.lit(power))
    at = curves.where("k is not null").select("pattern_id", "r", "k", grid.alias("g")).groupBy("pattern_id", "g").agg(F.sum(gap * gap).alias("contrast"))
    best = at.groupBy("pattern_id").agg(F.min(F.struct("contrast", "g.density", "g.scale")).alias("b"))
    return best.select("pattern_id", "b.density", "b.scale", "b.contrast")


def cross_covariance(points: DataFrame, radii: Sequence[float], first: str, second: str) -> DataFrame:
    """Mean product of the deviations of `first` at one point and `second` at the other, per shell."""
    mean = points.groupBy("pattern_id").agg(F.avg(first).alias("mf"), F.avg(second).alias("ms"))
    rich = points.join(mean, "pattern_id").withColumn("f", F.col(first) - F.col("mf")).withColumn("s", F.col(second) - F.col("ms"))
    met = pairs(rich, None, max(radii), ["f", "s"]).withColumn("shell", shells(radii))
    return met.groupBy("pattern_id", "shell").agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("i_f") * F.col("j_s")).alias("covariance"))


def kernel_mark_correlation(points: DataFrame, radii: Sequence[float], columns: Sequence[str]) -> DataFrame:
    """Mean linear kernel of the pairs of each shell, over its mean for all pairs of the pattern.

    The normaliser needs no pairs: it is (|sum of v|^2 - sum of |v|^2) / (n (n - 1)).
    """
    total = sum((F.sum(c) * F.sum(c) - F.sum(F.col(c) * F.col(c)) for c in columns[1:]), F.sum(columns[0]) * F.sum(columns[0]) - F.sum(F.col(columns[0]) * F.col(columns[0])))
    n = F.count(F.lit(1))
    whole = points.groupBy("pattern_id").agg(F.when(n > 1, total / F.nullif(n * (n - 1), F.lit(0))).alias("whole"))
    dot = sum((F.col(f"i_{c}") * F.col(f"j_{c}") for c in columns[1:]), F.col(f"i_{columns[0]}") * F.col(f"j_{columns[0]}"))
    met = pairs(points, None, max(radii), columns, unordered=True).withColumn("shell", shells(radii))
    return met.groupBy("pattern_id", "shell").agg(F.count(F.lit(1)).alias("pairs"), F.avg(dot).alias("mean")).join(whole, "pattern_id").select("pattern_id", "shell", "pairs", (F.col("mean") / F.nullif("whole", F.lit(0.0))).alias("correlation"))


def cross_k3d(points: DataFrame, source: str, target: str, radii: Sequence[float], volume: float) -> DataFrame:
    """Directed K in three dimensions (x, y, z), uncorrected: volume * pairs / (sources * targets)."""
    own, other = points.where(F.col("label") == source), points.where(F.col("label") == target)
    dz = F.col("i_z") - F.col("j_z")
    met = _at_radii(points, pairs(own, other, max(radii), ["z"]).withColumn("d2", F.col("d2") + dz * dz), radii)
    counts = met.groupBy("pattern_id", "r").agg(F.count(F.lit(1)).alias("pairs"))
    n = own.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("sources")).join(other.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("targets")), "pattern_id")
    out = on_all(counts, n.select("pattern_id"), levels(points, r=[float(r) for r in radii]), ["r"]).join(n, "pattern_id").withColumn("pairs", F.coalesce("pairs", F.lit(0)))
    return out.select("pattern_id", "r", "sources", "targets", "pairs", (volume * F.col("pairs") / (F.col("sources") * F.col("targets"))).alias("k"))
