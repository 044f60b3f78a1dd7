"""Connected components of an edge table by label contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep, map_arrow

#: Edges (16 bytes each) that one task may join; beyond, they are contracted in rounds.
ONE_TASK = 1_000_000


def _join(batches):
    """Union-find over the edges of one task."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for v, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(v), root(u)
            if a != b:
                up[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], ["node", "component"])


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node of edges(a, b): component is the smallest
    node that can be reached. Nodes are bigint.

    Few edges (counted, at most one_task) are joined by one task. More go through
    alternating large-star and small-star rounds: each node's neighbours are tied
    to the smallest of them, so paths shorten geometrically and no node gets more
    edges than it had. Every round is a table in the shared folder; the driver
    sees two sums a round. Empty input gives an empty table.
    """
    spark = edges.sparkSession
    now = keep(edges.where("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "cc")
    if now.count() <= one_task:
        return keep(map_arrow(now.coalesce(1), _join, "node bigint, component bigint"), "cc-joined")
    seen = None
    for _ in range(most_rounds):
        # large star: each neighbour above u goes to the least of u and its neighbours
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours not above u, and u itself, go to the least
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("x"), "m").where("x <> m").select(F.col("m").alias("v"), F.col("x").alias("u")).distinct()
        after = keep(small, "cc")
        sign = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        forget(spark, now)
        now = after
        if (sign["n"], sign["s"]) == seen:
            break
        seen = (sign["n"], sign["s"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
