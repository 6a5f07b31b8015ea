"""Vessel pairs on a causal time grid: who is near whom, and how close they will come."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Encounter, Grid
from ..functions.geo import distance_nm, norm, plane, propagate, velocity
from ..functions.grid import cell_id


def course(f: DataFrame) -> DataFrame:
    """Direction over ground: the segment's own bearing, else the reported course; never the heading."""
    own = F.when((F.col("segment_break_reason") == "") & (F.col("point_index") > 0) & (F.col("bearing_deg") >= 0) & (F.col("bearing_deg") < 360), F.col("bearing_deg"))
    native = F.when((F.col("cog") >= 0) & (F.col("cog") < 360), F.col("cog"))
    return f.withColumns({"course": F.coalesce(own, native), "direction_source": F.when(own.isNotNull(), "segment_bearing").when(native.isNotNull(), "native_cog").otherwise("none")})


def causal_grid(f: DataFrame, e: Encounter = Encounter()) -> DataFrame:
    """For each grid time and vessel the latest moving state at or before it, at most ``max_age_s`` old, moved on to the grid time.

    A latest state without direction hides older ones: the vessel is then absent. Only equal keys meet; there is no as-of join.
    """
    moving = course(f).where(F.col("sog") >= e.min_sog)
    first = (F.ceil(F.col("t") / e.bin_s) * e.bin_s).cast("bigint")
    last = F.col("t") + e.max_age_s
    spread = moving.withColumn("_g", first).where(F.col("_g") <= last).withColumn("g", F.explode(F.sequence(F.col("_g"), last.cast("bigint"), F.lit(e.bin_s).cast("bigint")))).drop("_g")
    latest = Window.partitionBy("g", "mmsi").orderBy(F.desc("t"), "date", "ordinal")
    won = spread.withColumn("_r", F.row_number().over(latest)).where((F.col("_r") == 1) & F.col("course").isNotNull())
    age = (F.col("g") - F.col("t")).cast("double")
    lon, lat = propagate(F.col("longitude"), F.col("latitude"), F.col("sog"), F.col("course"), age)
    return won.select("g", "mmsi", "t", lon.alias("lon"), lat.alias("lat"), "sog", "course", "direction_source", "track_id", age.alias("age_s"))


def _sides(states: DataFrame) -> tuple[DataFrame, DataFrame]:
    side = lambda s: states.select("g", *[F.col(c).alias(f"{c}_{s}") for c in states.columns if c != "g"])
    return side("a"), side("b")


def pairs_within(states: DataFrame, nm: float, max_lat: float = 60.0) -> DataFrame:
    """Pairs of a grid time at most ``nm`` apart, by an equi-join on buckets at least that wide up to ``max_lat``; the distance decides.

    Nearer to a pole a state of side b is put in as many buckets east and west as its latitude asks for.
    """
    tall = nm / 60.0 * 1.01
    wide = tall / math.cos(math.radians(max_lat))
    a, b = _sides(states)
    at = lambda s: (F.floor(F.col(f"lon_{s}") / wide), F.floor(F.col(f"lat_{s}") / tall))
    poleward = F.radians(F.least(F.abs("lat_b") + tall, F.lit(89.999999)))
    far = F.greatest(F.lit(1), F.least(F.ceil(tall / F.cos(poleward) / wide), F.lit(math.ceil(360 / wide)))).cast("int")
    across = F.transform(F.sequence(-far, far), lambda i: F.array(*[F.struct((at("b")[0] + i).alias("bx"), (at("b")[1] + j).alias("by")) for j in (-1, 0, 1)]))
    around = F.explode(F.flatten(across))
    near = b.withColumn("_b", around).select("*", "_b.bx", "_b.by").drop("_b")
    return a.withColumns({"bx": at("a")[0], "by": at("a")[1]}).join(near, ["g", "bx", "by"]).where(F.col("mmsi_a") < F.col("mmsi_b")).drop("bx", "by").where(_apart() <= nm)


def pairs_brute(states: DataFrame, nm: float) -> DataFrame:
    """The same from all pairs of a grid time: a check, not a plan."""
    a, b = _sides(states)
    return a.join(b, "g").where((F.col("mmsi_a") < F.col("mmsi_b")) & (_apart() <= nm))


def _apart() -> Column:
    return distance_nm(F.col("lon_a"), F.col("lat_a"), F.col("lon_b"), F.col("lat_b"))


def opportunities(pairs: DataFrame, g: Grid, e: Encounter = Encounter()) -> DataFrame:
    """Closest approach of each pair under constant velocity, and whether it is a candidate. Values are rounded as they are handed on."""
    c = F.col
    mid_lon, mid_lat = (c("lon_a") + c("lon_b")) / 2, (c("lat_a") + c("lat_b")) / 2
    (ax, ay), (bx, by) = (plane(c(f"lon_{s}"), c(f"lat_{s}"), mid_lon, mid_lat) for s in "ab")
    (au, av), (bu, bv) = (velocity(c(f"sog_{s}"), c(f"course_{s}")) for s in "ab")
    df = pairs.withColumns({"rx": bx - ax, "ry": by - ay, "ru": bu - au, "rv": bv - av, "_lon": mid_lon, "_lat": mid_lat})
    rv2, dot = c("ru") * c("ru") + c("rv") * c("rv"), c("rx") * c("ru") + c("ry") * c("rv")
    df = df.withColumns({"d": norm(c("rx"), c("ry")), "rv2": rv2, "h": F.when(rv2 > 1e-9, -(dot / rv2)), "dot": dot})
    df = df.withColumn("dcpa", F.when(c("h") > 0, norm(c("rx") + c("ru") * c("h"), c("ry") + c("rv") * c("h"))).otherwise(c("d")))
    df = df.withColumn("is_candidate", F.coalesce((c("h") > 0) & (c("h") * 60 <= e.tcpa_min) & (c("dcpa") <= e.dcpa_nm), F.lit(False)).cast("int"))
    score = 0.65 * (1 - c("dcpa") / e.dcpa_nm) + 0.35 * (1 - c("h") * 60 / e.tcpa_min)
    r = lambda x, n=6: F.round(x, n)
    return df.select(
        F.date_format(F.timestamp_seconds("g"), "yyyy-MM-dd").alias("date"), "g", "mmsi_a", "mmsi_b", F.abs(c("t_a") - c("t_b")).alias("state_skew_s"), "age_s_a", "age_s_b",
        *[r(c(f"{k}_{s}")).alias(f"{k}_{s}") for k in ("lon", "lat") for s in "ab"], *[r(c(f"{k}_{s}"), 3).alias(f"{k}_{s}") for k in ("sog", "course") for s in "ab"], "track_id_a", "track_id_b",
        cell_id(c("_lon"), c("_lat"), g).alias("cell_id"), r(c("d")).alias("current_distance_nm"), r(c("dcpa")).alias("dcpa_nm"), r(c("h") * 60).alias("tcpa_min"), r(F.sqrt(c("rv2"))).alias("relative_speed_kn"),
        r(F.when(c("d") > 1e-12, F.greatest(F.lit(0.0), -(c("dot") / c("d")))).otherwise(0.0)).alias("closing_speed_kn"), "is_candidate", F.when(c("is_candidate") == 1, r(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))).alias("encounter_score"),
    )


def exposure(records: DataFrame) -> DataFrame:
    """Opportunities of each day and cell."""
    pair = F.concat_ws("|", "mmsi_a", "mmsi_b")
    return records.where(F.col("cell_id").isNotNull()).groupBy("date", "cell_id").agg(F.count("*").alias("pair_opportunity_count"), F.count_distinct(pair).alias("unique_pairs"), F.round(F.avg("state_skew_s"), 6).alias("mean_state_skew_s"), F.max("state_skew_s").alias("max_state_skew_s"))


def islands(candidates: DataFrame, gap_s: int) -> DataFrame:
    """Adds ``island``: records of a pair and day that follow each other within the gap."""
    w = Window.partitionBy("date", "mmsi_a", "mmsi_b").orderBy("g")
    new = F.coalesce((F.col("g") - F.lag("g").over(w) > gap_s).cast("int"), F.lit(1))
    return candidates.withColumn("_new", new).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def episodes(records: DataFrame, e: Encounter = Encounter()) -> DataFrame:
    """Episodes of candidates. What is predicted comes from the first record alone."""
    first = F.min(F.struct("g", "dcpa_nm", "tcpa_min", "encounter_score", "current_distance_nm", "state_skew_s", "cell_id", F.round((F.col("lon_a") + F.col("lon_b")) / 2, 7).alias("lon_mid"), F.round((F.col("lat_a") + F.col("lat_b")) / 2, 7).alias("lat_mid"))).alias("f")
    by = islands(records.where("is_candidate = 1"), e.gap_s).groupBy("date", "mmsi_a", "mmsi_b", "island")
    made = by.agg(first, F.max("g").alias("end_s"), F.count("*").alias("record_count"), F.max("encounter_score").alias("max_score"), F.min("dcpa_nm").alias("min_dcpa_nm"), F.min("current_distance_nm").alias("min_distance_nm"))
    return made.select("date", "mmsi_a", "mmsi_b", "island", F.col("f.g").alias("t0"), "end_s", "record_count", "f.dcpa_nm", "f.tcpa_min", F.col("f.encounter_score").alias("first_score"), "f.current_distance_nm", "f.state_skew_s", "f.cell_id", "f.lon_mid", "f.lat_mid", "max_score", "min_dcpa_nm", "min_distance_nm")


def summary(records: DataFrame, e: Encounter = Encounter()) -> DataFrame:
    c = records.where("is_candidate = 1")
    pair = F.concat_ws("|", "mmsi_a", "mmsi_b")
    return islands(c, e.gap_s).agg(F.count("*").alias("candidates"), F.count_distinct(pair).alias("pairs"), F.count_distinct(F.concat_ws("|", "date", pair)).alias("pair_days"), F.count_distinct(F.concat_ws("|", "date", pair, F.col("island").cast("string"))).alias("episodes"))
