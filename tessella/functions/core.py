"""Building blocks of the spatial operators: bucketed pair joins, bins, ranks, envelopes, p-values.

Point tables have pattern_id, idx (unique in its pattern), x, y and marks. A pair join never
compares all points: both sides are put into square buckets three radii wide, one side is copied to
the buckets that its discs touch (2.8 on average), and buckets meet by an equi-join that no
pattern's size makes quadratic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut


def pairs(a: DataFrame, b: DataFrame | None, radius: float, columns: Sequence[str] = (), key: str = "pattern_id", unordered: bool = False, with_self: bool = False) -> DataFrame:
    """Pairs of points of one pattern within an inclusive radius: key, i, j, d2 and i_/j_ columns.

    Without b the points pair among themselves, by index, so coincident points still pair; with it,
    each point of a pairs with those of b. unordered keeps i < j. with_self keeps i = j.
    """
    own, other = a, a if b is None else b
    width, reach = 3.0 * float(radius), float(radius) * (1 + 1e-9)
    cell = lambda c: F.floor(c / width).cast("long")
    cells = lambda c: F.explode(F.sequence(cell(F.col(c) - reach), cell(F.col(c) + reach)))  # noqa: E731  one or two
    left = own.select(F.col(key).alias("_k"), F.col("idx").alias("i"), F.col("x").alias("i_x"), F.col("y").alias("i_y"), *[F.col(c).alias(f"i_{c}") for c in columns])
    left = left.select("*", cells("i_x").alias("gx")).select("*", cells("i_y").alias("gy"))
    right = other.select(F.col(key).alias("_k"), F.col("idx").alias("j"), F.col("x").alias("j_x"), F.col("y").alias("j_y"), *[F.col(c).alias(f"j_{c}") for c in columns])
    right = right.withColumn("gx", cell(F.col("j_x"))).withColumn("gy", cell(F.col("j_y")))
    dx, dy = F.col("i_x") - F.col("j_x"), F.col("i_y") - F.col("j_y")
    # a file's size says little about its pairs: the estimate would broadcast one side
    met = left.join(right.hint("merge"), ["_k", "gx", "gy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= float(radius) ** 2)
    if b is None:
        met = met.where("i < j") if unordered else met if with_self else met.where("i <> j")
    return met.withColumnRenamed("_k", key).drop("gx", "gy")


def nearest(a: DataFrame, b: DataFrame | None, radius: float, k: int = 1, key: str = "pattern_id", columns: Sequence[str] = ()) -> DataFrame:
    """The k nearest points within the radius by (distance, index): key, i, j, d2, rank."""
    w = Window.partitionBy(key, "i").orderBy("d2", "j")
    return pairs(a, b, radius, columns, key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_any(a: DataFrame, b: DataFrame | None, reach: float, k: int = 1, key: str = "pattern_id") -> DataFrame:
    """The k nearest points by (distance, index) however far they are: key, i, j, d2, rank, i_x ... j_y.

    Points that find fewer than k within the reach, and fewer than their pattern has, look again
    twice as far, until all have them. Without b a point is no neighbour of its own.
    """
    other = a if b is None else b
    size = other.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    own = 1 if b is None else 0
    rest = cut(a.select(key, "idx", "x", "y").join(size, key).withColumn("_want", F.least(F.col("_n") - own, F.lit(k))).drop("_n").where("_want > 0"))
    order, all_, found = Window.partitionBy(key, "i").orderBy("d2", "j"), Window.partitionBy(key, "i"), None
    while not rest.isEmpty():
        met = pairs(rest.drop("_want"), other.select(key, "idx", "x", "y"), reach, key=key)
        met = met.where("i <> j") if own else met
        near = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("_have", F.count(F.lit(1)).over(all_))
        want = rest.select(key, F.col("idx").alias("i"), "_want")
        done = cut(near.join(want, [key, "i"]).where("_have >= _want").drop("_have", "_want"))
        found = done if found is None else found.unionByName(done)
        rest = cut(rest.join(done.select(key, F.col("i").alias("idx")).distinct(), [key, "idx"], "left_anti"))
        reach *= 2
    return found if found is not None else nearest(a, b, reach, k, key)


def on_all(rows: DataFrame, keys: DataFrame, levels: DataFrame, on: Sequence[str]) -> DataFrame:
    """rows completed to every (key, level): a bin without rows stays, with nulls."""
    return keys.crossJoin(F.broadcast(levels)).join(rows, [*keys.columns, *on], "left")


def levels(df: DataFrame, **columns: Sequence) -> DataFrame:
    """A small table of parameters (radii, bins), one row per position."""
    return df.sparkSession.createDataFrame(list(zip(*columns.values())), list(columns))


def boundary_distance(window: tuple[float, float, float, float], x: str = "x", y: str = "y") -> Column:
    """Distance to the edge of a rectangle (x0, y0, x1, y1), for points inside."""
    x0, y0, x1, y1 = map(float, window)
    return F.least(F.col(x) - x0, x1 - F.col(x), F.col(y) - y0, y1 - F.col(y))


def area(window: tuple[float, float, float, float]) -> float:
    return float((window[2] - window[0]) * (window[3] - window[1]))


def average_rank(value: Column | str, *partition: str) -> Column:
    """Ranks from 1; ties share their mean rank."""
    w = Window.partitionBy(*partition).orderBy(value)
    tied = Window.partitionBy(*partition, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(tied) - 1) / 2.0


def envelope(curves: DataFrame, family: Sequence[str], alpha: float, replicate: str = "replicate", bin_: str = "bin", value: str = "value") -> DataFrame:
    """Extreme-rank-length global envelope of curves; replicate 0 is the observed one.

    Two-sided pointwise ranks, sorted within each curve and compared lexicographically, give each
    curve's depth (average rank over number of curves). -> family, replicate, depth, p_global,
    critical, kept. Bins must be there for every replicate.
    """
    family = list(family)
    low = average_rank(value, *family, bin_)
    count = F.count(F.lit(1)).over(Window.partitionBy(*family, bin_))
    ranked = curves.withColumn("_r", F.least(low, count + 1 - low))
    sorted_ = ranked.groupBy(*family, replicate).agg(F.array_sort(F.collect_list("_r")).alias("_ranks"))
    n = F.count(F.lit(1)).over(Window.partitionBy(*family))
    depth = sorted_.withColumn("depth", average_rank("_ranks", *family) / n).withColumn("_n", n)
    observed = F.max(F.when(F.col(replicate) == 0, F.col("depth"))).over(Window.partitionBy(*family))
    depth = depth.withColumn("p_global", F.sum(F.when(F.col("depth") <= observed, 1).otherwise(0)).over(Window.partitionBy(*family)) / F.col("_n"))
    # the largest depth such that at most alpha of all curves lie strictly below it
    below = F.rank().over(Window.partitionBy(*family).orderBy("depth")) - 1
    fits = F.when(below <= F.floor(F.lit(alpha) * F.col("_n") + 1e-12), F.col("depth"))
    depth = depth.withColumn("_fits", fits).withColumn("critical", F.max("_fits").over(Window.partitionBy(*family)))
    return depth.select(*family, replicate, "depth", "p_global", "critical", (F.col("depth") >= F.col("critical")).alias("kept"))


def envelope_bands(curves: DataFrame, family: Sequence[str], alpha: float, bin_: str = "bin", value: str = "value") -> DataFrame:
    """The observed curve (replicate 0) with the band of all curves that the global envelope keeps.

    -> family, bin, observed, lower, upper, outside, p_global.
    """
    family = list(family)
    kept = envelope(curves, family, alpha, bin_=bin_, value=value).select(*family, "replicate", "p_global", "kept")
    both = curves.join(kept, [*family, "replicate"])
    seen = F.max(F.when(F.col("replicate") == 0, F.col(value)))
    own = F.when(F.col("kept"), F.col(value))
    out = both.groupBy(*family, bin_).agg(seen.alias("observed"), F.min(own).alias("lower"), F.max(own).alias("upper"), F.max("p_global").alias("p_global"))
    return out.select(*family, bin_, "observed", "lower", "upper", ((F.col("observed") < F.col("lower")) | (F.col("observed") > F.col("upper"))).alias("outside"), "p_global")


def benjamini_hochberg(df: DataFrame, p: str, order: str, *partition: str, name: str = "q") -> DataFrame:
    """Step-up adjusted p-values; ties in p go by `order`."""
    up = Window.partitionBy(*partition).orderBy(p, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*partition))
    raw = df.withColumn("_raw", F.col(p) * n / F.row_number().over(up))
    down = Window.partitionBy(*partition).orderBy(F.desc(p), F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw")


def plus_one_p(at_least: Column, count: Column) -> Column:
    """(1 + null values at least the observed one) / (B + 1)."""
    return (1 + at_least) / (1 + count)


def available(value: Column, reason: str, when: Column) -> Column:
    """A value with its status: available, or insufficient data and why."""
    return F.struct(F.when(when, "available").otherwise("insufficient_data").alias("status"), F.when(when, value).alias("value"), F.when(~when, F.lit(reason)).alias("reason"))
