"""Connected components of an edge list by alternating large and small stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _settled(edges: DataFrame) -> bool:
    """Whether edges (u > v) are stars: one edge for each u, and no v is a u."""
    roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("low")))
    seen = roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low"))
    return not seen.where("up > 1 or up > 0 and low > 0").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: a, b. Per node with an edge: node, root (the smallest node of its component)."""
    u, v = F.col("u"), F.col("v")
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if _settled(now):
            break
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v).distinct()
        tops = now.join(least.select("u", "m"), "u", "left_semi")  # nodes that are local minima keep their own edges
        large = large.unionByName(tops.join(least, "u").select("u", F.col("m").alias("v")).where(u != v)).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        now = stash(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(u.alias("node"), v.alias("root")).unionByName(now.select(v.alias("node"), v.alias("root")).distinct())


def extended(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """components() of the edges behind roots, a result of it, and of edges (a, b): only the classes that these tie together are looked at."""
    ends = [F.coalesce(F.col(f"r{x}"), F.col(x)).alias(x) for x in ("a", "b")]
    side = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    moved = stash(components(edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(*ends)), "moved")
    old = roots.join(moved.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stash(old.unionByName(moved.join(roots.select("node"), "node", "left_anti")), "roots")
