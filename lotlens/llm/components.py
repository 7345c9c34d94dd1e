"""Connected components of a graph held as an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlens.llm.common import discard, materialise


def _star(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over edges (u, v) with u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    lowest = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lowest.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, root long): every node that has an edge, with the smallest node reachable from it.

    Only neighbour minima move, never a neighbour list, so a hub costs its edges and no task holds a group;
    Spark splits a hub's join partition at run time. Each round is written to the shared folder, which bounds lineage; rounds go on until nothing changes.
    Null ends and self-loops are ignored; no edges give an empty result.
    """
    e = edges.where(f"{a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e, seen = materialise(e, "cc"), None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen, old = tuple(state), e
        e = materialise(_star(e), "cc")
        discard(old)


def merged(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Components (node, root) with more edges (a, b): only the roots that these connect go through the rounds."""
    if labels is None:
        return materialise(connected_components(edges), "labels")
    ends = edges
    for x in ("a", "b"):
        ends = ends.join(labels.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")), x, "left").withColumn(x, F.coalesce(f"root_{x}", x))
    moved = connected_components(ends.select("a", "b").distinct())
    of = moved.select(F.col("node").alias("root"), F.col("root").alias("new"))
    now = labels.join(of, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return materialise(now.unionByName(moved.join(labels, "node", "left_anti")), "labels")
