"""Connected components by alternating large-star and small-star steps, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _with_least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).drop("k")


def _is_starred(edges: DataFrame) -> bool:
    """Whether every edge leads to a root: each node has one edge, and no edge leads to a node that has one."""
    if edges.groupBy("u").count().filter("count > 1").take(1):
        return False
    return not edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").take(1)


def components(links: DataFrame, scratch: Scratch, name: str = "edges") -> DataFrame:
    """(node, component) for every node of the links (a, b); a component's id is its smallest node.

    Each round is two aggregations joined back to the edges, so a node with very many links is split by
    Spark's skew handling and no component is ever held in one place. Rounds are logarithmic in a
    component's longest path; each is written to the scratch folder.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, n = scratch.save(edges, f"{name}0"), 0
    while not _is_starred(edges):
        n += 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        starred = _with_least(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(starred.select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        before, edges = f"{name}{n - 1}", scratch.save(small, f"{name}{n}")
        scratch.drop(before)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def merged(found: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Components after more links: only links between different components so far are followed, as links of components."""
    side = lambda s: found.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above = components(between, scratch, f"{name}edges").select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = found.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = above.select(F.col("component").alias("node"), F.col("top").alias("component")).join(found.select("node"), "node", "left_anti")
    return scratch.save(old.unionByName(alone), name)
