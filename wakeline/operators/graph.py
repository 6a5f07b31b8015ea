"""Connected components by least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the session's shared folder and cut from its lineage."""
    return written(df)


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``node`` and ``root`` (its least reachable node). Labels jump to their label's label, so long chains take few rounds; each round is checkpointed."""
    edges = settled(edges.select("a", "b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_m")).select("node", F.least("node", "_m").alias("root"))
    for _ in range(rounds):
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_m"))
        low = label.join(near, "node").select("node", F.least("root", "_m").alias("root"), F.col("root").alias("_old"))
        jump = low.select(F.col("node").alias("root"), F.col("root").alias("_far"))
        new = settled(low.join(jump, "root", "left").select("node", F.least("root", F.coalesce("_far", "root")).alias("root"), "_old"))
        changed = new.where("root <> _old").limit(1).count()
        label = new.select("node", "root")
        if not changed:
            return label
    raise RuntimeError("components did not settle")
