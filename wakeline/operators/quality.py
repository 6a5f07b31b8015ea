"""Cropping, cleaning and auditing of raw reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Grid
from ..functions.grid import inside
from ..functions.parse import number, timestamp
from .places import values_at

OPTIONAL = {"length": (0, 500), "width": (0, 100), "draft": (0, 30)}


def crop(df: DataFrame, g: Grid) -> DataFrame:
    return df.where(inside(number(df, "longitude"), number(df, "latitude"), g))


def crop_counters(df: DataFrame, g: Grid) -> DataFrame:
    lon, lat = number(df, "longitude"), number(df, "latitude")
    bad, kept = lon.isNull() | lat.isNull(), F.coalesce(inside(lon, lat, g), F.lit(False))
    return df.agg(
        F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(bad).alias("invalid_position"), F.count_if(~bad & ~kept).alias("outside"),
        F.min(F.when(kept, F.col("base_date_time"))).alias("first_time"), F.max(F.when(kept, F.col("base_date_time"))).alias("last_time"),
    )


def classify(df: DataFrame, g: Grid) -> DataFrame:
    """Adds ``drop_reason``: the first rule that a report fails, or null. Of repeated reports the first in order stays."""
    lon, lat, sog = (number(df, c) for c in ("longitude", "latitude", "sog"))
    first = (
        F.when(~F.coalesce(F.trim("mmsi").rlike("^[1-9][0-9]{8}$"), F.lit(False)), "invalid_mmsi")
        .when(timestamp(F.col("base_date_time")).isNull(), "invalid_timestamp")
        .when(~F.coalesce(inside(lon, lat, g), F.lit(False)), "invalid_position")
        .when(sog.isNull(), "missing_sog")
        .when((sog < 0) | (sog > 60), "invalid_sog")
    )
    same = Window.partitionBy("mmsi", "base_date_time", "longitude", "latitude", F.col("_first").isNull()).orderBy("ordinal")
    numbered = df.withColumn("_first", first).withColumn("_n", F.row_number().over(same))
    return numbered.withColumn("drop_reason", F.when(F.col("_first").isNull() & (F.col("_n") > 1), "duplicate_point").otherwise(F.col("_first"))).drop("_first", "_n")


def clean(df: DataFrame, g: Grid) -> DataFrame:
    """Reports that pass all rules; unusable optional values become null."""
    kept = classify(df, g).where(F.col("drop_reason").isNull()).drop("drop_reason")
    out = {c: number(kept, c) for c in ("longitude", "latitude", "sog")}
    cog, heading = number(kept, "cog"), number(kept, "heading")
    out["cog"] = F.when((cog >= 0) & (cog < 360), cog)
    out["heading"] = F.when((heading != 511) & heading.between(0, 360), heading)
    out |= {c: F.when(number(kept, c).between(a, b), number(kept, c)) for c, (a, b) in OPTIONAL.items() if c in kept.columns}
    return kept.withColumns(out)


def clean_counters(df: DataFrame, g: Grid) -> DataFrame:
    return classify(df, g).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def audit_missing(df: DataFrame, fields: list[str]) -> DataFrame:
    """Null count and percentage of each field, from one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n_null")) for c in fields])).alias("p")
    return one.select(pairs, "_n").select("p.field", "p.n_null", F.round(F.try_divide(100.0 * F.col("p.n_null"), F.col("_n")), 4).alias("pct_null"))


def audit_summary(df: DataFrame) -> DataFrame:
    """Rows, vessels, first and last time, and how many values are missing or out of range; counted before cleaning, from one pass."""
    v = {c: number(df, c) for c in ("longitude", "latitude", "sog", "cog", "heading")}
    place = v["longitude"].isNull() | v["latitude"].isNull()
    flags = {
        "missing_position": place, "position_outside_world": ~place & ~(v["longitude"].between(-180, 180) & v["latitude"].between(-90, 90)), "missing_sog": v["sog"].isNull(), "negative_sog": v["sog"] < 0, "sog_gt_60_kn": v["sog"] > 60,
        "missing_cog": v["cog"].isNull(), "cog_outside_0_360": (v["cog"] < 0) | (v["cog"] >= 360), "missing_heading": v["heading"].isNull(), "invalid_heading": (v["heading"] == 511) | ~v["heading"].between(0, 360),
    }
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct("mmsi").alias("unique_mmsi"), F.min("base_date_time").alias("first_time"), F.max("base_date_time").alias("last_time"), *[F.count_if(x).alias(k) for k, x in flags.items()])


def audit_numeric(df: DataFrame, fields: list[str]) -> DataFrame:
    """Count, extremes, mean, upper median and 95 % value of each field.

    The quantiles are values at a place of the sorted column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("v")) for c in fields])).alias("p")).select("p.*").where(F.col("v").isNotNull())
    whole = long.groupBy("field").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))
    found = values_at(long, {"p50": lambda n: F.floor(n / 2), "p95": lambda n: F.floor((n - 1) * 0.95)})
    return whole.join(F.broadcast(found), "field").select("field", "n", "least", "mean", "p50", "p95", "most")  # a row for each field


def audit_top(df: DataFrame, field: str, n: int = 20) -> DataFrame:
    return df.groupBy(F.col(field).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)
