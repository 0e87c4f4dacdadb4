"""Shapes and fields on rasters of cells: bands, hotspots, box statistics, orientation, landmark fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import pairs


def banded_profile(points: DataFrame, signed: Column, edges: Sequence[float], areas: Sequence[float], value: str = "value", label: str = "label") -> DataFrame:
    """Cells by band [e_k, e_k+1) of a signed distance: counts, observed values, mean, labels, density per mm².

    areas are the bands' areas in µm². Cells beyond the edges belong to no band.
    """
    cases = F.when(F.lit(False), F.lit(None).cast("int"))
    for k in range(len(edges) - 1):
        cases = cases.when((signed >= float(edges[k])) & (signed < float(edges[k + 1])), k)
    size = F.element_at(F.array(*[F.lit(float(a)) for a in areas]), F.col("band") + 1)
    rows = points.withColumn("band", cases).where("band is not null").groupBy("pattern_id", "band")
    out = rows.agg(F.count(F.lit(1)).alias("cells"), F.count(value).alias("observed"), F.avg(value).alias("mean"), F.count_distinct(label).alias("labels"))
    return out.withColumn("density", F.col("cells") / size * 1e6)


def disc_hotspot(points: DataFrame, radius: float) -> DataFrame:
    """The cell whose disc, itself included, holds most cells; the smallest index among equals."""
    near = pairs(points, None, radius, with_self=True).groupBy("pattern_id", "i").agg(F.count(F.lit(1)).alias("cells"))
    top = near.groupBy("pattern_id").agg(F.max(F.struct("cells", F.negative("i").alias("o"))).alias("top"))
    return top.select("pattern_id", (-F.col("top.o")).alias("idx"), "top.cells")


def _boxes(points: DataFrame, width: float) -> DataFrame:
    gx, gy = F.floor(F.col("x") / width), F.floor(F.col("y") / width)
    return points.groupBy("pattern_id", gx.alias("gx"), gy.alias("gy")).agg(F.count(F.lit(1)).alias("m"))


def lacunarity(points: DataFrame, width: float, grid: int, sizes: Sequence[int]) -> DataFrame:
    """E[M²] / E[M]² of the mass M of boxes of each size that glide over a grid; empty boxes count."""
    each = F.explode(F.array(*[F.lit(int(s)) for s in sizes])).alias("size")
    at = _boxes(points, width).select("*", each)
    start = lambda c: F.explode(F.sequence(F.greatest(F.col(c) - F.col("size") + 1, F.lit(0)), F.least(F.col(c), F.lit(grid) - F.col("size"))))
    at = at.select("*", start("gx").alias("bx")).select("*", start("gy").alias("by"))
    mass = at.groupBy("pattern_id", "size", "bx", "by").agg(F.sum("m").alias("m"))
    boxes = (grid - F.col("size") + 1) * (grid - F.col("size") + 1)
    out = mass.groupBy("pattern_id", "size").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("ss"))
    return out.select("pattern_id", "size", (F.col("ss") * boxes / (F.col("s") * F.col("s"))).alias("lacunarity"))


def raster_morphology(points: DataFrame, width: float) -> DataFrame:
    """Area, perimeter and Euler characteristic of the closed squares that hold cells."""
    f, x, y = _boxes(points, width), F.col("gx"), F.col("gy")
    side = lambda a, b, way: F.struct(a.alias("a"), b.alias("b"), F.lit(way).alias("way"))
    edges = f.select("pattern_id", F.explode(F.array(side(x, y, 0), side(x, y + 1, 0), side(x, y, 1), side(x + 1, y, 1))).alias("e")).groupBy("pattern_id", "e").agg(F.count(F.lit(1)).alias("k"))
    edges = edges.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("k") == 1, 1)).alias("outer"))
    corner = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    corners = f.select("pattern_id", F.explode(F.array(corner(x, y), corner(x + 1, y), corner(x, y + 1), corner(x + 1, y + 1))).alias("c")).distinct()
    corners = corners.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("corners"))
    out = f.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("squares")).join(edges, "pattern_id").join(corners, "pattern_id")
    return out.select("pattern_id", (F.col("squares") * width * width).alias("area"), (F.col("outer") * width).alias("perimeter"), (F.col("corners") - F.col("edges") + F.col("squares")).alias("euler"))


def directors(points: DataFrame, angle: Column, width: float) -> DataFrame:
    """Mean axial direction and nematic order of each box; angles count modulo pi."""
    gx, gy = F.floor(F.col("x") / width), F.floor(F.col("y") / width)
    c, s = F.avg(F.cos(2 * angle)), F.avg(F.sin(2 * angle))
    out = points.groupBy("pattern_id", gx.alias("gx"), gy.alias("gy")).agg(F.count(F.lit(1)).alias("n"), c.alias("c"), s.alias("s"))
    return out.select("pattern_id", "gx", "gy", "n", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")).alias("order"), (F.atan2("s", "c") / 2).alias("director"))


def half_defects(field: DataFrame) -> DataFrame:
    """Plaquettes of a director field around which the direction turns by half a turn: charge ±1/2."""
    at = lambda dx, dy, name: field.select("pattern_id", (F.col("gx") - dx).alias("gx"), (F.col("gy") - dy).alias("gy"), F.col("director").alias(name))
    keys = ["pattern_id", "gx", "gy"]
    ring = at(0, 0, "d0").join(at(1, 0, "d1"), keys).join(at(1, 1, "d2"), keys).join(at(0, 1, "d3"), keys)
    turn = lambda a, b: F.col(b) - F.col(a) - F.pi() * F.round((F.col(b) - F.col(a)) / F.pi())
    total = turn("d0", "d1") + turn("d1", "d2") + turn("d2", "d3") + turn("d3", "d0")
    return ring.select(*keys, (F.round(total / F.pi()) / 2).alias("charge")).where("charge <> 0")


def small_wave_limit(modes: DataFrame, highest: float) -> DataFrame:
    """Power at wave number zero by a straight line through modes (k, power) up to `highest`, and its exponent.

    -> modes, s0 (intercept), alpha (slope of log power on log k), ratio (s0 over the largest power).
    """
    low = modes.where((F.col("k") <= highest) & (F.col("power") > 0))
    out = low.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("modes"), F.regr_intercept("power", "k").alias("s0"), F.regr_slope(F.log("power"), F.log("k")).alias("alpha"), F.max("power").alias("top"))
    return out.select("pattern_id", "modes", "s0", "alpha", (F.col("s0") / F.col("top")).alias("ratio"))


def landmark_fits(landmarks: DataFrame, key: str = "pattern_id") -> DataFrame:
    """Least-squares rigid and affine maps of landmarks x, y -> u, v, with their root mean square residuals.

    One pass of second moments. Rigid is a rotation and a shift; its residual is the moments'
    total less twice the length of the summed products. Affine needs landmarks off one line.
    """
    var, cov = F.var_pop, F.covar_pop
    m = landmarks.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"),
        var("x").alias("xx"), var("y").alias("yy"), cov("x", "y").alias("xy"), cov("x", "u").alias("xu"), cov("y", "u").alias("yu"), cov("x", "v").alias("xv"), cov("y", "v").alias("yv"), (var("u") + var("v")).alias("tt"),
    )
    c = F.col
    det = F.when(c("xx") * c("yy") - c("xy") * c("xy") > 1e-12 * c("xx") * c("yy"), c("xx") * c("yy") - c("xy") * c("xy"))
    m = m.withColumn("theta", F.atan2(c("xv") - c("yu"), c("xu") + c("yv"))).withColumn("det", det)
    m = m.withColumn("a", (c("yy") * c("xu") - c("xy") * c("yu")) / c("det")).withColumn("b", (c("xx") * c("yu") - c("xy") * c("xu")) / c("det"))
    m = m.withColumn("c", (c("yy") * c("xv") - c("xy") * c("yv")) / c("det")).withColumn("d", (c("xx") * c("yv") - c("xy") * c("xv")) / c("det"))
    rigid = c("tt") + c("xx") + c("yy") - 2 * F.sqrt(F.pow(c("xv") - c("yu"), F.lit(2)) + F.pow(c("xu") + c("yv"), F.lit(2)))
    affine = c("tt") - (c("a") * c("xu") + c("b") * c("yu") + c("c") * c("xv") + c("d") * c("yv"))
    root = lambda e: F.sqrt(F.greatest(e, F.lit(0.0)))
    return m.select(
        key, "n", "theta", (c("mu") - F.cos("theta") * c("mx") + F.sin("theta") * c("my")).alias("shift_x"), (c("mv") - F.sin("theta") * c("mx") - F.cos("theta") * c("my")).alias("shift_y"), root(rigid).alias("rigid_rmse"),
        "a", "b", "c", "d", (c("mu") - c("a") * c("mx") - c("b") * c("my")).alias("e"), (c("mv") - c("c") * c("mx") - c("d") * c("my")).alias("f"), root(affine).alias("affine_rmse"),
    )
