"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _solved(edges: DataFrame) -> bool:
    """Whether distinct edges (u, v), u > v, are stars: each u has one v, which is no other edge's u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("lower"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("lower"), F.lit(1).alias("root")))
    return not ends.groupBy("x").agg(F.sum("lower").alias("lower"), F.max("root").alias("root")).filter("lower + root > 1").limit(1).count()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for all nodes of edges (u, v), where component is the least node reachable.

    Each round is written to the shared folder, so a lost executor costs one round. A
    node's edges are reduced to its least neighbour before they are joined, and hot nodes are split by
    adaptive execution. No edges give an empty result; loops and repeated edges don't matter.
    """
    ends = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u != v")
    now = written(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    while not _solved(now):
        now = written(_stars(_stars(now, large=True), large=False), label)
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def extended(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of the edges behind groups and of edges (u, v); only the graph of the groups is solved anew."""
    of = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    between = edges.select("u", "v").join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    merged = components(between)
    new = merged.join(groups.select("node"), "node", "left_anti")
    old = groups.join(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return written(old.unionByName(new.select("node", "component")), "components")
