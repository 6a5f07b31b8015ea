"""Values at given places of sorted columns, without sorting a column in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def values_at(rows: DataFrame, places: dict[str, Callable[[Column], Column]], buckets: int = BUCKETS) -> DataFrame:
    """For each ``field`` of (field, v): the value at each named place of its sorted values, as columns.

    A place is a function of the count, from 0. Distinct values are counted; the counts of a fixed number of equal ranges of each
    field tell in which range a place lies, and only the distinct values of those ranges are sorted, each range by a task of its own.
    """
    counts = rows.where(F.col("v").isNotNull()).groupBy("field", F.col("v").cast("double").alias("v")).agg(F.count("*").alias("n"))
    ends = counts.groupBy("field").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.sum("n").alias("_all"))
    part = F.coalesce(F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    ranged = counts.join(F.broadcast(ends), "field").withColumn("_b", F.least(F.floor(part * buckets), F.lit(buckets - 1)).cast("int"))
    by_range = ranged.groupBy("field", "_b").agg(F.sum("n").alias("_n"), F.first("_all").alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy("field").orderBy("_b"))  # a fixed number of ranges
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("_q"), f(F.col("_all")).cast("bigint").alias("_at")) for k, f in places.items()])).alias("_p")
    found = by_range.withColumn("_upto", upto).select("field", "_b", "_n", "_upto", asked).select("field", "_b", "_n", "_upto", "_p.*")
    found = found.where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_n"))).select("field", "_b", "_q", (F.col("_at") - (F.col("_upto") - F.col("_n"))).alias("_rest"))
    inside = ranged.select("field", "_b", "v", "n").join(F.broadcast(found), ["field", "_b"])  # a row for each field and place
    running = F.sum("n").over(Window.partitionBy("field", "_q").orderBy("v"))
    hit = inside.withColumn("_run", running).where(F.col("_run") > F.col("_rest")).groupBy("field", "_q").agg(F.min("v").alias("v"))
    return hit.groupBy("field").agg(*[F.max(F.when(F.col("_q") == k, F.col("v"))).alias(k) for k in places])


def linear(shares: dict[str, float]) -> dict[str, Callable[[Column], Column]]:
    """The two places that each linear quantile lies between; ``between`` puts their values together."""
    out = {}
    for name, q in shares.items():
        out[f"{name}_low"] = lambda n, q=q: F.floor((n - 1) * q)
        out[f"{name}_high"] = lambda n, q=q: F.ceil((n - 1) * q)
    return out


def between(name: str, q: float, n: Column) -> Column:
    low, high, at = F.col(f"{name}_low"), F.col(f"{name}_high"), (n - 1) * q
    return low + (high - low) * (at - F.floor(at))
