"""Embedding tables: aggregation, dispersion, variograms, retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import on_all, levels, pairs

#: Queries that are sent to the index together.
_BLOCK = 100_000


def squared_distance(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def mean_vectors(rows: DataFrame, vector: str, weight: Column, *by: str) -> DataFrame:
    """Weighted mean of each component: by, pos, mean."""
    each = rows.select(*by, weight.alias("w"), F.posexplode(vector).alias("pos", "v"))
    return each.groupBy(*by, "pos").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))


def dispersion(rows: DataFrame, vector: str, *by: str) -> DataFrame:
    """Mean squared distance of a group's vectors to their mean: the components' variances, summed."""
    each = rows.select(*by, F.posexplode(vector).alias("pos", "v")).withColumn("v", F.col("v").cast("double"))
    return each.groupBy(*by, "pos").agg(F.var_pop("v").alias("var"), F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max("n").alias("n"), F.sum("var").alias("dispersion"))


def vector_semivariogram(points: DataFrame, vector: str, edges: Sequence[float]) -> DataFrame:
    """Mean of half the squared vector distance per lag bin, the last one closed."""
    met = pairs(points, None, max(edges), [vector], unordered=True)
    spans = list(zip(edges, edges[1:]))
    bin_ = F.lit(None).cast("int")
    for k, (lo, hi) in enumerate(spans):
        top = F.col("d2") <= float(hi) ** 2 if k == len(spans) - 1 else F.col("d2") < float(hi) ** 2
        bin_ = F.when((F.col("d2") >= float(lo) ** 2) & top, F.lit(k)).otherwise(bin_)
    g = met.withColumn("bin", bin_).where("bin is not null").groupBy("pattern_id", "bin").agg(F.avg(0.5 * squared_distance(f"i_{vector}", f"j_{vector}")).alias("gamma"), F.count(F.lit(1)).alias("pairs"))
    out = on_all(g, points.select("pattern_id").distinct(), levels(points, bin=list(range(len(spans)))), ["bin"])
    return out.select("pattern_id", F.col("bin").cast("int"), F.coalesce("pairs", F.lit(0)).alias("pairs"), "gamma")


def retrieve(queries: DataFrame, index: DataFrame, vector: str, k: int, id_: str, group: str) -> DataFrame:
    """The k nearest index rows of each query that aren't of the query's own group; ties by id.

    Queries are collected and sent in blocks; for each, a task keeps k rows a query before the
    shuffle, so that what is sent doesn't grow with the index.
    """
    import heapq

    import numpy as np
    import pyarrow as pa

    few = queries.select(id_, group, vector).collect()
    blocks = []
    for at in range(0, len(few), _BLOCK):
        some = few[at : at + _BLOCK]
        q = np.array([r[vector] for r in some], np.float64).reshape(len(some), -1)
        blocks.append(queries.sparkSession.sparkContext.broadcast((q, [r[id_] for r in some], np.array([r[group] for r in some], object))))

    def run(batches, shared):
        q, ids, groups = shared.value
        best = [[] for _ in ids]
        for batch in batches:
            own, kinds = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            x = np.array(batch.column(2).to_pylist(), np.float64).reshape(len(own), -1)
            for at in range(0, len(ids), 256):
                d = ((q[at : at + 256, None] - x[None]) ** 2).sum(-1) if len(own) else np.zeros((0, 0))
                for i in range(d.shape[0]):
                    free = np.flatnonzero(kinds != groups[at + i])
                    if len(free) > k:  # all that tie with the k-th: ids decide among them
                        free = free[d[i, free] <= np.partition(d[i, free], k - 1)[k - 1]]
                    best[at + i] = heapq.nsmallest(k, best[at + i] + [(float(d[i, j]), own[j]) for j in free])
        rows = [(ids[i], j, d) for i, b in enumerate(best) for d, j in b]
        cols = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query", "found", "d2"])

    from pyspark.sql.window import Window

    rows, kind = index.select(F.col(id_).cast("long"), group, vector), "query long, found long, d2 double"
    near = index.sparkSession.createDataFrame([], kind)
    for block in blocks:
        near = near.union(rows.mapInArrow(lambda batches, b=block: run(batches, b), kind))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("d2", "found"))).where(F.col("rank") <= k)
