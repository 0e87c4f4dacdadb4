"""Connected components by alternating large-star and small-star rounds over shuffled edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut


def connected_components(edges: DataFrame, cut: Cut, rounds: int = 100) -> DataFrame:
    """edges(a, b) of orderable ids -> (node, root): each node that has an edge to another one, but
    the roots, with the smallest node that it reaches.

    Every edge points from its larger end u to its smaller end v. A large-star round moves each
    edge to v's own smallest neighbour; a small-star round links u's smaller neighbours to the
    smallest of them. Neither gathers a node's edges: minima are aggregated before their shuffle
    and joined back as plain tables, whose hot keys the engine can split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = cut(e), None
    for _ in range(rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        low = cut(e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"))
        large = cut(e.join(low, F.col("v") == F.col("w"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct())
        near = cut(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w"))
        moved = large.join(near, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut(moved.union(near.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        cut.drop(e, low, large, near)
        e = nxt
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
