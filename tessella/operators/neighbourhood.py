"""Neighbour compositions, co-occurrence, enrichment and graph operators over radius graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core import nearest_any, pairs
from ..functions.lineage import cut
from .waves import connected


def radius_edges(points: DataFrame, radius: float, columns: Sequence[str] = ()) -> DataFrame:
    """Undirected edges stored once, i < j, with distance and angle."""
    met = pairs(points, None, radius, columns, unordered=True)
    return met.withColumn("distance", F.sqrt("d2")).withColumn("angle", F.atan2(F.col("j_y") - F.col("i_y"), F.col("j_x") - F.col("i_x")))


def knn_edges(points: DataFrame, k: int, reach: float) -> DataFrame:
    """Undirected union of each point's k nearest neighbours; reach is where the search starts."""
    near = nearest_any(points, None, reach, k)
    return near.select("pattern_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d2").distinct()


def cooccurrence(points: DataFrame, radii: Sequence[float], label: str = "label") -> DataFrame:
    """Directed label pairs within each cumulative radius: count * total / (row sum * column sum)."""
    met = pairs(points, None, max(radii), [label]).select("pattern_id", f"i_{label}", f"j_{label}", "d2", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("r")).where("d2 <= r * r")
    counts = met.groupBy("pattern_id", "r", F.col(f"i_{label}").alias("a"), F.col(f"j_{label}").alias("b")).agg(F.count(F.lit(1)).alias("pairs"))
    rows = counts.groupBy("pattern_id", "r", "a").agg(F.sum("pairs").alias("row"))
    total = rows.groupBy("pattern_id", "r").agg(F.sum("row").alias("total"))
    seen = points.select("pattern_id", F.col(label).alias("a")).distinct()
    grid = seen.join(seen.withColumnRenamed("a", "b"), "pattern_id").join(total, "pattern_id")
    column = rows.withColumnsRenamed({"a": "b", "row": "col"})  # directed pairs are symmetric
    out = grid.join(rows, ["pattern_id", "r", "a"], "left").join(column, ["pattern_id", "r", "b"], "left").join(counts, ["pattern_id", "r", "a", "b"], "left")
    n = F.coalesce("pairs", F.lit(0))
    return out.select("pattern_id", "r", "a", "b", n.alias("pairs"), F.when((F.col("row") > 0) & (F.col("col") > 0), n * F.col("total") / (F.col("row") * F.col("col"))).alias("score"))


def enrichment(points: DataFrame, radius: float, label: str = "label") -> DataFrame:
    """Unordered label-pair edges with their exact mean and variance when labels are shuffled.

    With E edges, A pairs of edges that share a point and D disjoint ones, the second moment adds
    the chances that two, three and four given points carry the needed labels.
    """
    edges = pairs(points, None, radius, [label], unordered=True)
    counts = edges.groupBy("pattern_id", F.least(f"i_{label}", f"j_{label}").alias("a"), F.greatest(f"i_{label}", f"j_{label}").alias("b")).agg(F.count(F.lit(1)).alias("edges"))
    ends = edges.select("pattern_id", F.explode(F.array("i", "j")).alias("idx")).groupBy("pattern_id", "idx").agg(F.count(F.lit(1)).alias("degree"))
    graph = ends.groupBy("pattern_id").agg((F.sum("degree") / 2).alias("e"), F.sum(F.col("degree") * (F.col("degree") - 1) / 2).alias("adjacent"))
    graph = graph.withColumn("disjoint", F.col("e") * (F.col("e") - 1) / 2 - F.col("adjacent"))
    n = points.groupBy("pattern_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    own = points.groupBy("pattern_id", label).agg(F.count(F.lit(1)).cast("double").alias("k"))
    a, b = own.select("pattern_id", F.col(label).alias("a"), F.col("k").alias("ka")), own.select("pattern_id", F.col(label).alias("b"), F.col("k").alias("kb"))
    grid = a.join(b, "pattern_id").where("a <= b").join(n, "pattern_id").join(graph, "pattern_id").join(counts, ["pattern_id", "a", "b"], "left")
    ka, kb, nn, same = F.col("ka"), F.col("kb"), F.col("n"), F.col("a") == F.col("b")
    pair = nn * (nn - 1)
    p1 = F.when(same, ka * (ka - 1) / pair).otherwise(2 * ka * kb / pair)
    triple, four = pair * (nn - 2), pair * (nn - 2) * (nn - 3)
    p2 = F.when(same, ka * (ka - 1) * (ka - 2) / triple).otherwise((ka * kb * (kb - 1) + kb * ka * (ka - 1)) / triple)
    p3 = F.when(same, ka * (ka - 1) * (ka - 2) * (ka - 3) / four).otherwise(4 * ka * (ka - 1) * kb * (kb - 1) / four)
    mean = F.col("e") * p1
    var = mean + 2 * F.col("adjacent") * p2 + 2 * F.col("disjoint") * p3 - mean * mean
    out = grid.select("pattern_id", "a", "b", F.coalesce("edges", F.lit(0)).alias("edges"), mean.alias("mean"), var.alias("variance"))
    return out.withColumn("z", F.when(F.col("variance") > 1e-9, (F.col("edges") - F.col("mean")) / F.sqrt("variance")))


def neighbourhood_mixing(points: DataFrame, radius: float, label: str = "label") -> DataFrame:
    """Shares of directed label pairs, their expectation under random labels, and row entropies."""
    counts = pairs(points, None, radius, [label]).groupBy("pattern_id", F.col(f"i_{label}").alias("a"), F.col(f"j_{label}").alias("b")).agg(F.count(F.lit(1)).alias("pairs"))
    row = counts.groupBy("pattern_id", "a").agg(F.sum("pairs").alias("row"))
    total = row.groupBy("pattern_id").agg(F.sum("row").alias("total"))
    p = counts.join(row, ["pattern_id", "a"]).withColumn("share", F.col("pairs") / F.col("row"))
    entropy = p.groupBy("pattern_id", "a").agg((-F.sum(F.col("share") * F.log("share"))).alias("row_entropy"))
    n = points.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    own = points.groupBy("pattern_id", label).agg(F.count(F.lit(1)).alias("k"))
    out = counts.join(total, "pattern_id").join(entropy, ["pattern_id", "a"]).join(n, "pattern_id")
    out = out.join(own.select("pattern_id", F.col(label).alias("a"), F.col("k").alias("ka")), ["pattern_id", "a"]).join(own.select("pattern_id", F.col(label).alias("b"), F.col("k").alias("kb")), ["pattern_id", "b"])
    expected = F.col("ka") * (F.col("kb") - F.when(F.col("a") == F.col("b"), 1).otherwise(0)) / (F.col("n") * (F.col("n") - 1))
    return out.select("pattern_id", "a", "b", "pairs", (F.col("pairs") / F.col("total")).alias("fraction"), expected.alias("expected"), "row_entropy")


def neighbourhood_map(points: DataFrame, radii: Sequence[float], least_neighbours: int, dominance: float, label: str = "label") -> DataFrame:
    """Per cell and radius: neighbours, effective diversity and the dominant label if its share is enough."""
    met = pairs(points, None, max(radii), [label]).select("pattern_id", "i", f"j_{label}", "d2", F.explode(F.array(*[F.lit(float(r)) for r in radii])).alias("r")).where("d2 <= r * r")
    counts = met.groupBy("pattern_id", F.col("i").alias("idx"), "r", F.col(f"j_{label}").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    n = counts.groupBy("pattern_id", "idx", "r").agg(F.sum("k").alias("neighbours"), F.sum(F.col("k") * F.log("k")).alias("klk"), F.max(F.struct("k", F.negative(F.ascii("b")).alias("o"), "b")).alias("top"))
    n = n.where(F.col("neighbours") >= least_neighbours)
    entropy = F.log("neighbours") - F.col("klk") / F.col("neighbours")
    return n.select("pattern_id", "idx", "r", "neighbours", F.exp(entropy).alias("effective"), F.when(F.col("top.k") >= dominance * F.col("neighbours"), F.col("top.b")).alias("dominant"))


def soft_composition(points: DataFrame, simplex: Sequence[str]) -> DataFrame:
    """Mean membership of each class, Shannon entropy in nats and the effective number of classes."""
    means = points.groupBy("pattern_id").agg(*[F.avg(c).alias(c) for c in simplex])
    h = sum((F.when(F.col(c) > 0, -F.col(c) * F.log(c)).otherwise(0.0) for c in simplex), F.lit(0.0))
    return means.withColumn("entropy", h).withColumn("effective", F.exp("entropy"))


def soft_neighbourhood(points: DataFrame, radius: float, simplex: Sequence[str]) -> DataFrame:
    """Each cell's mean neighbour memberships."""
    return pairs(points, None, radius, simplex).groupBy("pattern_id", F.col("i").alias("idx")).agg(F.count(F.lit(1)).alias("neighbours"), *[F.avg(f"j_{c}").alias(c) for c in simplex])


def soft_pair_mixing(points: DataFrame, radius: float, simplex: Sequence[str]) -> DataFrame:
    """Mean product of memberships over directed pairs for each class pair, and its random expectation."""
    met = pairs(points, None, radius, simplex)
    each = [F.avg(F.col(f"i_{a}") * F.col(f"j_{b}")).alias(f"{a}__{b}") for a in simplex for b in simplex]
    observed = met.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("visits"), *each)
    sums = points.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in simplex], *[F.sum(F.col(a) * F.col(b)).alias(f"x_{a}__{b}") for a in simplex for b in simplex])
    out = observed.join(sums, "pattern_id")
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}__{b}").alias("mass"), ((F.col(f"s_{a}") * F.col(f"s_{b}") - F.col(f"x_{a}__{b}")) / (F.col("n") * (F.col("n") - 1))).alias("expected")) for a in simplex for b in simplex])).alias("v")
    return out.select("pattern_id", "visits", rows).select("pattern_id", "visits", "v.*")


def ordinal_composition(points: DataFrame, level: str) -> DataFrame:
    """Shares of ordered classes and their cumulative shares."""
    from pyspark.sql.window import Window

    counts = points.groupBy("pattern_id", level).agg(F.count(F.lit(1)).alias("k"))
    n = F.sum("k").over(Window.partitionBy("pattern_id"))
    up = F.sum("k").over(Window.partitionBy("pattern_id").orderBy(level).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("pattern_id", F.col(level).alias("level"), "k", (F.col("k") / n).alias("fraction"), (up / n).alias("cumulative"))


def dirichlet_energy(points: DataFrame, radius: float, signals: Sequence[str]) -> DataFrame:
    """Sum over edges of the squared signal difference, raw and over the signals' total variation."""
    d2 = sum(((F.col(f"i_{s}") - F.col(f"j_{s}")) * (F.col(f"i_{s}") - F.col(f"j_{s}")) for s in signals), F.lit(0.0))
    energy = pairs(points, None, radius, signals, unordered=True).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(d2).alias("energy"))
    spread = points.groupBy("pattern_id").agg(sum((F.var_pop(s) * F.count(F.lit(1)) for s in signals), F.lit(0.0)).alias("spread"))
    return energy.join(spread, "pattern_id").select("pattern_id", "edges", "energy", F.when(F.col("spread") > 0, F.col("energy") / F.col("spread")).alias("normalised"))


def local_roughness(points: DataFrame, radius: float, signal: str = "value") -> DataFrame:
    """Per node: squared difference to its neighbours over its degree; isolated nodes have null."""
    d = F.col(f"i_{signal}") - F.col(f"j_{signal}")
    near = pairs(points, None, radius, [signal]).groupBy("pattern_id", F.col("i").alias("idx")).agg(F.count(F.lit(1)).alias("degree"), F.sum(d * d).alias("rough"))
    return points.select("pattern_id", "idx").join(near, ["pattern_id", "idx"], "left").select("pattern_id", "idx", F.coalesce("degree", F.lit(0)).alias("degree"), (F.col("rough") / F.col("degree")).alias("roughness"))


def graph_smoothing(points: DataFrame, radius: float, signal: str = "value") -> DataFrame:
    """One step of message passing: the mean of a node and its neighbours."""
    near = pairs(points, None, radius, [signal], with_self=True)
    return near.groupBy("pattern_id", F.col("i").alias("idx")).agg(F.avg(f"j_{signal}").alias("smoothed"))


def _triples(edges: DataFrame) -> DataFrame:
    """pattern_id, i, j, k of each triangle of edges(pattern_id, i, j), and li, lj, lk if edges have li
    and lj. Edges leave the node with fewer of them, so a node's leaving edges are few however many meet
    at it, and only those are paired."""
    named = "li" in edges.columns
    degree = edges.select("pattern_id", F.explode(F.array("i", "j")).alias("n")).groupBy("pattern_id", "n").agg(F.count(F.lit(1)).alias("d"))
    of = lambda c: degree.select("pattern_id", F.col("n").alias(c), F.struct("d", "n").alias(f"o{c}"))
    both = edges.join(of("i"), ["pattern_id", "i"]).join(of("j"), ["pattern_id", "j"])
    first = F.col("oi") < F.col("oj")
    pick = lambda x, y, n: F.when(first, F.col(x)).otherwise(F.col(y)).alias(n)
    out = cut(both.select("pattern_id", pick("i", "j", "a"), pick("j", "i", "b"), *([pick("li", "lj", "la"), pick("lj", "li", "lb")] if named else [])))
    other = out.select("pattern_id", "a", F.col("b").alias("c"), *([F.col("lb").alias("lc")] if named else []))
    wedge = out.join(other, ["pattern_id", "a"]).where("b < c")
    met = wedge.join(edges.select("pattern_id", F.col("i").alias("b"), F.col("j").alias("c")), ["pattern_id", "b", "c"])
    return met.select("pattern_id", F.col("a").alias("i"), F.col("b").alias("j"), F.col("c").alias("k"), *([F.col(f"l{x}").alias(f"l{y}") for x, y in zip("abc", "ijk")] if named else []))


def triangles(points: DataFrame, radius: float, label: str = "label") -> DataFrame:
    """Triangles of the radius graph by their sorted labels."""
    e = pairs(points, None, radius, [label], unordered=True).select("pattern_id", "i", "j", F.col(f"i_{label}").alias("li"), F.col(f"j_{label}").alias("lj"))
    kind = F.array_sort(F.array("li", "lj", "lk"))
    return _triples(cut(e)).groupBy("pattern_id", F.array_join(kind, "-").alias("motif")).agg(F.count(F.lit(1)).alias("triangles"))


def clustering(points: DataFrame, radius: float) -> DataFrame:
    """Local clustering coefficient of each node of degree two or more."""
    e = cut(pairs(points, None, radius, unordered=True).select("pattern_id", "i", "j"))
    t = _triples(e).select("pattern_id", F.explode(F.array("i", "j", "k")).alias("idx")).groupBy("pattern_id", "idx").agg(F.count(F.lit(1)).alias("t"))
    d = e.select("pattern_id", F.explode(F.array("i", "j")).alias("idx")).groupBy("pattern_id", "idx").agg(F.count(F.lit(1)).alias("degree")).where("degree > 1")
    return d.join(t, ["pattern_id", "idx"], "left").select("pattern_id", "idx", "degree", (2 * F.coalesce("t", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).alias("clustering"))


def bond_order(points: DataFrame, k: int, reach: float, symmetry: int = 6) -> DataFrame:
    """|mean exp(i * symmetry * angle)| over each point's k nearest neighbours; reach is where the search starts."""
    near = nearest_any(points, None, reach, k)
    angle = symmetry * F.atan2(F.col("j_y") - F.col("i_y"), F.col("j_x") - F.col("i_x"))
    psi = near.groupBy("pattern_id", F.col("i").alias("idx")).agg(F.avg(F.cos(angle)).alias("re"), F.avg(F.sin(angle)).alias("im"), F.count(F.lit(1)).alias("neighbours"))
    return psi.select("pattern_id", "idx", "neighbours", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("order"))


def density_clusters(points: DataFrame, radius: float, least: int) -> DataFrame:
    """DBSCAN: core points have `least` points within the radius, themselves included; cores within
    the radius share a cluster, named by its smallest core; a border point joins the smallest one it
    touches."""
    near = cut(pairs(points, None, radius, with_self=True).select("pattern_id", "i", "j"))
    core = cut(near.groupBy("pattern_id", "i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("pattern_id", "i"))
    links = near.join(core, ["pattern_id", "i"], "left_semi").join(core.withColumnRenamed("i", "j"), ["pattern_id", "j"], "left_semi")
    labels = connected(core, links.select("pattern_id", "i", "j"), ["pattern_id"])
    border = near.join(labels.select("pattern_id", F.col("i").alias("j"), "cluster"), ["pattern_id", "j"]).join(core, ["pattern_id", "i"], "left_anti").groupBy("pattern_id", "i").agg(F.min("cluster").alias("cluster"))
    return labels.select("pattern_id", "i", "cluster").withColumn("core", F.lit(True)).union(border.select("pattern_id", "i", "cluster").withColumn("core", F.lit(False))).withColumnRenamed("i", "idx")


def disc_scan(points: DataFrame, radius: float, mark: str = "mark", stratum: str | None = None) -> DataFrame:
    """Bernoulli scan: per pattern the cell-centred disc with the largest likelihood ratio.

    Discs need 2 to n/2 cells inside and 2 outside and an enriched inside; ties keep the smallest centre.
    """
    met = pairs(points, None, radius, [mark], with_self=True).groupBy("pattern_id", "i").agg(F.count(F.lit(1)).cast("double").alias("n_in"), F.sum(f"j_{mark}").cast("double").alias("m_in"))
    total = points.groupBy("pattern_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(mark).cast("double").alias("m"))
    d = met.join(total, "pattern_id").where("n_in >= 2 and n_in <= n / 2 and n - n_in >= 2")
    xlogx = lambda a, b: F.when(F.expr(a) > 0, F.expr(a) * F.log(F.expr(a) / F.expr(b))).otherwise(0.0)
    llr = xlogx("m_in", "n_in") + xlogx("n_in - m_in", "n_in") + xlogx("m - m_in", "n - n_in") + xlogx("(n - n_in) - (m - m_in)", "n - n_in") - xlogx("m", "n") - xlogx("n - m", "n")
    d = d.withColumn("llr", F.round(F.when(F.col("m_in") * (F.col("n") - F.col("n_in")) > (F.col("m") - F.col("m_in")) * F.col("n_in"), llr).otherwise(0.0), 9))
    best = d.groupBy("pattern_id").agg(F.max(F.struct("llr", F.negative("i").alias("o"), "i", "n_in", "m_in")).alias("b"))
    return best.select("pattern_id", F.col("b.i").alias("centre"), F.col("b.llr").alias("llr"), F.col("b.n_in").cast("long").alias("inside"), F.col("b.m_in").cast("long").alias("marked"))


def close_pairs(points: DataFrame, radius: float, saturation: int) -> DataFrame:
    """Sufficient statistics of hard-distance models: close pairs, and neighbours capped at saturation."""
    near = pairs(points, None, radius).groupBy("pattern_id", "i").agg(F.count(F.lit(1)).alias("k"))
    return near.groupBy("pattern_id").agg((F.sum("k") / 2).cast("long").alias("close_pairs"), F.sum(F.least("k", F.lit(saturation))).cast("long").alias("saturated"))


def disc_census(points: DataFrame, radius: float, classes: Sequence[str], label: str = "label") -> DataFrame:
    """Share of each class in the disc around every cell, the cell itself included."""
    met = pairs(points, None, radius, [label], with_self=True)
    shares = [F.avg(F.when(F.col(f"j_{label}") == c, 1.0).otherwise(0.0)).alias(f"share_{c}") for c in classes]
    return met.groupBy("pattern_id", F.col("i").alias("idx")).agg(F.count(F.lit(1)).alias("members"), *shares)


def exposure(points: DataFrame, radius: float, high: float, treated: str = "mark") -> DataFrame:
    """Treated share of each unit's neighbours and its exposure class; units without neighbours have none."""
    near = pairs(points, None, radius, [treated]).groupBy("pattern_id", F.col("i").alias("idx"), F.col(f"i_{treated}").alias("own")).agg(F.avg(f"j_{treated}").alias("share"))
    kind = F.concat_ws("_", F.when(F.col("own") == 1, "treated").otherwise("control"), F.when(F.col("share") >= high, "high").otherwise("low"))
    return near.select("pattern_id", "idx", "share", kind.alias("exposure"))


def k_3d(points: DataFrame, radii: Sequence[float], volume: float, z: str = "z") -> DataFrame:
    """Homogeneous K of points in space, uncorrected: volume * ordered pairs / (n (n - 1))."""
    dz = F.col(f"i_{z}") - F.col(f"j_{z}")
    met = pairs(points, None, max(radii), [z], unordered=True).withColumn("d3", F.col("d2") + dz * dz)
    counts = [F.count(F.when(F.col("d3") <= float(r) ** 2, 1)).alias(f"k{i}") for i, r in enumerate(radii)]
    n = points.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    wide = n.join(met.groupBy("pattern_id").agg(*counts), "pattern_id", "left")
    each = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("r"), F.coalesce(f"k{i}", F.lit(0)).alias("pairs")) for i, r in enumerate(radii)])).alias("v")
    out = wide.select("pattern_id", "n", each).select("pattern_id", "n", "v.r", "v.pairs")
    return out.withColumn("k", F.when(F.col("n") > 1, 2 * volume * F.col("pairs") / (F.col("n") * (F.col("n") - 1))))


def moran_permutation(points: DataFrame, radius: float, replicates: int, seed: int, value: str = "value") -> DataFrame:
    """Moran's I of each pattern with a plus-one p-value over shuffled values; the pattern is the unit
    of work. Points are taken in index order, so partitions don't matter."""
    import numpy as np
    import pandas as pd

    from ..functions.draws import orders

    def run(key, own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        ids, z = own["idx"].to_numpy(), own[value].to_numpy(float)
        z = z - z.mean()
        row = {"pattern_id": key[0], "moran_i": None, "p_high": None, "replicates": replicates}
        if len(edges) and (z * z).sum() > 0:
            edges = edges.sort_values(["i", "j"])
            a, b = np.searchsorted(ids, edges["i"].to_numpy()), np.searchsorted(ids, edges["j"].to_numpy())
            scale = len(z) / len(a) / (z * z).sum()
            seen = scale * (z[a] * z[b]).sum()
            hits = 0
            drawn = orders(ids.tolist(), seed, replicates)
            for some in np.array_split(np.arange(replicates), max(1, replicates // 64)):
                zs = z[drawn[some]]
                hits += int((scale * (zs[:, a] * zs[:, b]).sum(1) >= seen - 1e-12).sum())
            row |= {"moran_i": seen, "p_high": (1 + hits) / (1 + replicates)}
        return pd.DataFrame([row]).astype({"moran_i": "float64", "p_high": "float64"})

    edges = pairs(points, None, radius, unordered=True).select("pattern_id", "i", "j")
    return points.select("pattern_id", "idx", value).groupBy("pattern_id").cogroup(edges.groupBy("pattern_id")).applyInPandas(run, "pattern_id long, moran_i double, p_high double, replicates long")
