"""Connected components by alternating large-star and small-star steps over an edge table.

Each step joins the edges with every vertex's least neighbour: by broadcast while these are counted as few, else by a
salted join, so a vertex with a third of all edges stays spread. Minima are pre-aggregated; each step's edges are written
to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_ROWS, staged

SALTS = 16
ROUNDS = 60


def _with_least(pairs: DataFrame, few: bool) -> DataFrame:
    """(u, v) with ``least``: the smallest of u and its neighbours v. The minima are broadcast only if the edges were counted as few."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    if few:
        return pairs.join(F.broadcast(least), "u")
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"])


def _are_stars(edges: DataFrame) -> bool:
    """Whether each vertex has one edge down and none leads on: then the stars are the components."""
    roles = edges.select(F.col("hi").alias("v"), F.lit(1).alias("high"), F.lit(0).alias("low")).union(edges.select("lo", F.lit(0), F.lit(1)))
    seen = roles.groupBy("v").agg(F.sum("high").alias("high"), F.max("low").alias("low"))
    return seen.filter("high > 1 or (high = 1 and low = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the edges (a, b: long); a component is its least id."""
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = staged(e, "components")
    few = e.count() <= BROADCAST_ROWS // 2  # vertices are at most twice the edges, and steps never add edges
    for _ in range(ROUNDS):
        if _are_stars(e):
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = _with_least(both, few).filter("v > u").select(F.col("v").alias("hi"), F.col("least").alias("lo")).distinct()
        down = _with_least(large.select(F.col("hi").alias("u"), F.col("lo").alias("v")), few)
        small = down.select(F.col("v").alias("hi"), F.col("least").alias("lo")).union(down.select(F.col("u").alias("hi"), F.col("least").alias("lo"))).filter("hi > lo").distinct()
        e = staged(small, "components")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def extended(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links (a, b): only the components that the links join are run again."""
    of = lambda side: F.coalesce(F.col(f"c{side}"), F.col(side))
    named = lambda side: found.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    mapped = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(of("a").alias("a"), of("b").alias("b"))
    merged = connected_components(mapped)
    kept = found.join(merged.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    fresh = merged.join(found.select("id"), "id", "left_anti")
    return staged(kept.union(fresh.select("id", "component")), "components")
