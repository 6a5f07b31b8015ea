"""Trajectory segments, motion features and track lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Segmentation
from ..functions.geo import angular_delta, bearing_deg, haversine_nm
from ..functions.parse import seconds


def features(df: DataFrame, s: Segmentation = Segmentation()) -> DataFrame:
    """Segments of each vessel and day, and the motion from one report to the next.

    Reports without position or speed are left out first. Every step is a window over (date, mmsi) in time order, ties in input order: one exchange, one sort.
    """
    df = df.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull() & F.col("sog").isNotNull())
    df = df.withColumn("t", seconds(F.col("base_date_time"))).withColumn("date", F.substring("base_date_time", 1, 10))
    w = Window.partitionBy("date", "mmsi").orderBy("t", "ordinal")
    lag = lambda c: F.lag(c).over(w)
    gap, far = F.col("time_gap_s"), F.col("distance_gap_nm")
    df = df.withColumns({"_n": F.row_number().over(w), "time_gap_s": F.col("t") - lag("t"), "_lon": lag("longitude"), "_lat": lag("latitude"), "_sog": lag("sog")})
    df = df.withColumn("distance_gap_nm", haversine_nm(F.col("_lon"), F.col("_lat"), F.col("longitude"), F.col("latitude")))
    df = df.withColumn("implied_sog_kn", F.when(gap > 0, far / (gap / 3600.0)))
    reason = (
        F.when(F.col("_n") == 1, "new_mmsi")
        .when(gap <= 0, "non_increasing_time")
        .when(gap > s.time_gap_s, "time_gap")
        .when(far > s.distance_nm, "distance_gap")
        .when(F.col("implied_sog_kn") > s.speed_kn, "implied_speed_gap")
        .otherwise("")
    )
    df = df.withColumn("segment_break_reason", reason)
    df = df.withColumn("bearing_deg", F.when(F.col("segment_break_reason") == "", bearing_deg(F.col("_lon"), F.col("_lat"), F.col("longitude"), F.col("latitude"))))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"seg_no": F.sum((F.col("segment_break_reason") != "").cast("int")).over(run), "bearing_delta_deg": angular_delta(lag("bearing_deg"), F.col("bearing_deg"))})
    in_seg = F.col("bearing_deg").isNotNull()
    df = df.withColumns({"point_index": F.col("_n") - F.max(F.when(F.col("segment_break_reason") != "", F.col("_n"))).over(run), "sog_delta_kn": F.when(in_seg, F.col("sog") - F.col("_sog"))})
    r = lambda c: F.round(c, 6)
    return df.withColumns(
        {
            "track_id": F.concat(F.col("mmsi"), F.lit("_"), F.lpad(F.col("seg_no").cast("string"), 4, "0")), "accel_kn_per_min": r(F.col("sog_delta_kn") / (gap / 60.0)), "turn_rate_deg_per_min": r(F.col("bearing_delta_deg") / (gap / 60.0)),
            **{c: r(F.col(c)) for c in ("distance_gap_nm", "implied_sog_kn", "bearing_deg", "bearing_delta_deg", "sog_delta_kn")},
        }
    ).drop("_n", "_lon", "_lat", "_sog")


def long_tracks(f: DataFrame, min_points: int) -> DataFrame:
    return f.withColumn("track_points", F.count("*").over(Window.partitionBy("date", "track_id"))).where(F.col("track_points") >= min_points)


def histogram(value: Column, edges: list[float]) -> Column:
    """Index of the bin whose lower edge is the last at or below the value."""
    out = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        out = F.when(value >= e, i).otherwise(out)
    return out


def binned(df: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """Counts of all bins, empty ones too."""
    found = df.select(histogram(value, edges).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
