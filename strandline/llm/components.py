"""Connected components by alternating small-star and large-star steps, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import stage


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours to the smallest of them; only nodes with several of them need the join."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
    others = edges.join(low.where("n > 1").select("a", "low"), "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return low.select("a", F.col("low").alias("b")).union(others).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node past its smaller neighbour to that one's smallest neighbour."""
    low = edges.groupBy("a").agg(F.min("b").alias("up")).select(F.col("a").alias("b"), "up")
    return edges.join(low, "b", "left").select("a", F.coalesce("up", "b").alias("b")).distinct()


def components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node that can be reached.

    Edges are held as a > b. A step shortens the way to the smallest node like the doubling of a path, so max_steps is never
    met by a graph that fits on a cluster; it raises if it is. Rows of a hub are split by AQE, minima are pre-aggregated.
    Loops and edges with nulls are left out; an empty table gives an empty one. Ends when all is stars."""
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(_small_star(now), "cc")
    for _ in range(max_steps):
        deep = now.join(now.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        if deep.isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            break
        now = stage(_small_star(_large_star(now)), "cc")
    else:
        raise RuntimeError(f"components: no end after {max_steps} steps")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
