"""Connected components by alternating star contraction.

Each round points every node at the least node it can see, first over all its
neighbours and then over its lesser ones, until the edges are stars round the
least node of each component. Only group minima and equi-joins are used, so a
hub with millions of edges is pre-aggregated and its join can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.plans.staging import stage, unstage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction over staged directed edges (u, v) with u > v."""
    if large:
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    least = stage(near.groupBy("u").agg(F.min("v").alias("w")), "cc-min")
    moved = near.join(least, "u")
    m = F.least("u", "w")
    if large:
        out = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), m.alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), m.alias("v")).union(least.select("u", F.col("w").alias("v")))
    done = stage(out.where(F.col("u") != F.col("v")).distinct(), "cc-edges")
    unstage(least)
    return done


def _is_stars(edges: DataFrame) -> bool:
    """Whether no end of an edge (u, v) has a second v of its own."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("hub")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("hub").alias("hub"))
    return not seen.where("out > 1 or out = 1 and hub = 1").limit(1).count()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node of its set.

    Edges are undirected; self-loops, repeated edges and edges with a null end
    add nothing (a node that has only those is not returned). An empty edge
    table gives an empty result. Sets that are not whole after max_rounds, far
    beyond the square of the logarithm of any table's rows, raise RuntimeError.
    """
    e = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    e = e.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u > v")
    now = stage(e.distinct(), "cc-edges")
    for _ in range(max_rounds):
        if _is_stars(now):
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        mid = _star(now, large=True)
        nxt = _star(mid, large=False)
        unstage(now, mid)
        now = nxt
    raise RuntimeError(f"components are not whole after {max_rounds} rounds")
