"""Connected components of an edge table, by alternating large and small stars.

Every round is a handful of joins and aggregates over the edges; a round's edges are written to the
shared folder, so lineage stays short and nothing is collected. A hub's edges meet its minimum in a join
whose both sides come fresh from an exchange, so adaptive execution can split a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Scratch


def _star(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """(u, v) to (v, least of u and all of u's): pairs keep their direction; u itself gets its own minimum."""
    low = scratch.keep(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    linked = pairs.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    new = scratch.keep(linked.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    scratch.drop(low, pairs)
    return new


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node that has an edge. Self edges and repeats count for nothing.

    Raises where ``rounds`` do not settle; a round shortens every path by more than half, so 60 do for any graph that fits a cluster.
    """
    now = scratch.keep(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = _star(scratch, scratch.keep(large))
        scratch.drop(low, now)
        found = new.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
        now = new
        if (found.n, found.h) == mark:
            break
        mark = (found.n, found.h)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
