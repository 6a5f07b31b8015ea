"""Interpretable anomaly scores of single reports, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Grid
from ..functions.geo import angular_delta, direction_bin
from ..functions.grid import cell_id, inside
from .places import between, linear, values_at

#: Indicators and their weights.
WEIGHTS = {"low_empirical_route_support": 0.35, "direction_mismatch": 0.25, "high_turn": 0.15, "high_accel": 0.10, "high_speed": 0.10, "suspicious_stop": 0.15, "implied_speed": 0.10}


def score(f: DataFrame, known: DataFrame, g: Grid, *keys: str, moving_sog: float = 1.0) -> DataFrame:
    """Every report on the grid with its indicators, score and tier. ``known``: patterns; a grid bounds them, so they are broadcast."""
    normal = known.where("is_normal = 1").select(*keys, F.col("cell_id"), F.col("dominant_direction_bin").alias("_bin"), F.col("is_high_confidence").alias("_high"))
    df = f.withColumn("cell_id", cell_id(F.col("longitude"), F.col("latitude"), g)).where(F.col("cell_id").isNotNull()).join(F.broadcast(normal), [*keys, "cell_id"], "left")
    moving, bare, own = F.col("sog") >= moving_sog, F.col("_bin").isNull(), direction_bin(F.coalesce("bearing_deg", "cog"))
    apart = F.abs(own - F.col("_bin"))
    flags = {
        "low_empirical_route_support": moving & bare, "direction_mismatch": moving & (F.least(apart, 8 - apart) >= 2), "high_turn": F.col("turn_rate_deg_per_min") >= 30, "high_accel": F.abs("accel_kn_per_min") >= 3,
        "high_speed": F.col("sog") >= 15, "suspicious_stop": (F.col("sog") < 0.5) & (F.col("_high") == 1), "implied_speed": F.col("implied_sog_kn") >= 30,
    }
    df = df.withColumns({k: F.coalesce(v, F.lit(False)).cast("int") for k, v in flags.items()})
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    n = sum((F.col(k) for k in WEIGHTS), F.lit(0))
    df = df.withColumns({"anomaly_score": F.round(F.least(total, F.lit(1.0)), 6), "indicator_count": n, "reasons": F.array_join(F.array_compact(F.array(*[F.when(F.col(k) == 1, k) for k in WEIGHTS])), ";")})
    tier = F.when((F.col("low_empirical_route_support") == 1) & (F.col("indicator_count") == 1), "low_support_only").when(F.col("indicator_count") >= 2, "corroborated_candidate").when(F.col("indicator_count") == 1, "single_indicator_candidate").otherwise("no_candidate_evidence")
    return df.withColumn("evidence_tier", tier).drop("_bin", "_high")


def candidates(scored: DataFrame, least: float = 0.35) -> DataFrame:
    return scored.where(F.col("anomaly_score") >= least)


def counters(points: DataFrame) -> DataFrame:
    """Candidates by tier and by reason."""
    tiers = points.groupBy(F.col("evidence_tier").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("tier"))
    reasons = points.select(F.explode(F.split("reasons", ";")).alias("name")).groupBy("name").agg(F.count("*").alias("n")).withColumn("kind", F.lit("reason"))
    return tiers.unionByName(reasons)


def targets(points: DataFrame) -> DataFrame:
    """For each track and day, the cell with most corroborated candidates; then the highest score, then the first id."""
    by_cell = points.where("evidence_tier = 'corroborated_candidate'").groupBy("date", "track_id", "cell_id").agg(F.count("*").alias("n"), F.round(F.sum("anomaly_score"), 6).alias("score_sum"))
    best = Window.partitionBy("date", "track_id").orderBy(F.desc("n"), F.desc("score_sum"), "cell_id")
    return by_cell.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def direction_audit(f: DataFrame, min_sog: float = 1.0) -> DataFrame:
    """How derived and reported directions agree."""
    m = f.where(F.col("sog") >= min_sog).select("bearing_deg", "cog", angular_delta(F.col("bearing_deg"), F.col("cog")).alias("d"))
    a, b = F.col("bearing_deg"), F.col("cog")
    shares = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    found = values_at(m.select(F.lit("d").alias("field"), F.col("d").alias("v")), linear(shares))
    counted = m.agg(
        F.count("*").alias("moving_rows"), F.count_if(a.isNotNull()).alias("derived_available"), F.count_if(b.isNotNull()).alias("cog_available"), F.count_if(a.isNotNull() & b.isNotNull()).alias("both_available"),
        F.count_if(a.isNull() & b.isNotNull()).alias("cog_fallback"), F.count_if(a.isNull() & b.isNull()).alias("no_direction"), F.count_if(direction_bin(a) == direction_bin(b)).alias("same_bin"),
        F.count_if(F.col("d") <= 22.5).alias("within_22_5"), F.count_if(F.col("d") <= 45).alias("within_45"), F.count("d").alias("_n"), F.lit("d").alias("field"),
    )
    both = counted.join(F.broadcast(found), "field", "left")
    return both.withColumns({k: F.round(between(k, q, F.col("_n")), 6) for k, q in shares.items()}).drop("field", "_n", *(f"{k}_{e}" for k in shares for e in ("low", "high")))


def case_tracks(points: DataFrame, n: int = 7) -> DataFrame:
    """Tracks with most candidates: extremes, and how often each reason applies."""
    by = points.groupBy("date", "mmsi", "track_id").agg(
        F.count("*").alias("points"), F.round(F.avg("anomaly_score"), 6).alias("mean_score"), F.max("anomaly_score").alias("max_score"), F.min("sog").alias("min_sog"), F.max("sog").alias("max_sog"),
        *[F.sum(k).cast("bigint").alias(f"n_{k}") for k in WEIGHTS],
    )
    return by.orderBy(F.desc("points"), F.desc("max_score"), "date", "track_id").limit(n)


#: Shifts that are tried, in degrees of longitude and latitude.
SHIFTS = ((0.035, 0.0), (-0.035, 0.0), (0.0, 0.035), (0.0, -0.035), (0.055, 0.025), (-0.055, 0.025), (0.025, -0.055), (-0.025, -0.055), (0.085, 0.045), (-0.085, -0.045))
INJECTIONS = ("normal_control", "speed_surge", "route_deviation", "course_reversal", "unexpected_stop")


def pool(f: DataFrame, known: DataFrame, g: Grid, least: float = 0.35, min_sog: float = 1.0) -> DataFrame:
    """Moving reports with a direction, on cells of regular routes, that score as normal; ``_high`` tells high-confidence cells."""
    routes = known.where("is_normal = 1").select("cell_id", F.col("is_high_confidence").alias("_high"))
    course = F.coalesce("bearing_deg", "cog")
    scored = score(f.where((F.col("sog") >= min_sog) & course.isNotNull()), known, g, moving_sog=min_sog)
    return scored.where(F.col("anomaly_score") < least).join(F.broadcast(routes), "cell_id").select(*f.columns, "_high")  # a grid bounds the routes


def inject(f: DataFrame, known: DataFrame, g: Grid, per_type: int = 500, seed: int = 20260527, least: float = 0.35) -> DataFrame:
    """Seeded sample of normal reports for each kind of synthetic anomaly, changed accordingly. Stops are put on high-confidence cells, where there are any.

    ``_skipped`` is 1 for a report that would have to move off all routes but finds no free cell among the shifts; it stays as it was.
    """
    normal = pool(f, known, g, least)
    best = normal.agg(F.max("_high").alias("_best"))  # one row
    key = F.sha2(F.concat_ws("|", F.col("ordinal").cast("string"), F.lit(str(seed))), 256)
    routes = known.where("is_normal = 1").select("cell_id", F.col("dominant_direction_bin").alias("_bin"))
    cells = routes.agg(F.collect_set("cell_id").alias("_cells"))  # cells of a grid are bounded, so the set of them fits one row
    out = None
    for kind in INJECTIONS:
        rows = normal.crossJoin(F.broadcast(best)).where("_high = _best").drop("_best") if kind == "unexpected_stop" else normal
        picked = rows.drop("_high").withColumn("_k", F.sha2(F.concat(key, F.lit(kind)), 256)).orderBy("_k", "ordinal").limit(per_type).drop("_k").withColumns({"injection": F.lit(kind), "_skipped": F.lit(0)})
        if kind in ("speed_surge", "route_deviation"):
            spots = F.array(*[F.struct((F.col("longitude") + a).alias("x"), (F.col("latitude") + b).alias("y")) for a, b in SHIFTS])
            free = F.filter(spots, lambda s: inside(s["x"], s["y"], g) & ~F.array_contains(F.col("_cells"), cell_id(s["x"], s["y"], g)))
            picked = picked.crossJoin(F.broadcast(cells)).withColumn("_at", F.get(free, 0))
            moved = {"longitude": F.round(F.coalesce("_at.x", "longitude"), 6), "latitude": F.round(F.coalesce("_at.y", "latitude"), 6), "_skipped": F.col("_at").isNull().cast("int")}
            picked = picked.withColumns(moved).drop("_cells", "_at")
        if kind == "speed_surge":
            picked = picked.withColumns({"sog": F.lit(22.0), "implied_sog_kn": F.lit(40.0), "accel_kn_per_min": F.lit(5.0)})
        elif kind == "route_deviation":
            picked = picked.withColumn("sog", F.greatest("sog", F.lit(4.0)))
        elif kind == "course_reversal":
            there = picked.withColumn("_c", cell_id(F.col("longitude"), F.col("latitude"), g)).join(F.broadcast(routes.withColumnRenamed("cell_id", "_c")), "_c", "left")
            back = F.pmod(F.coalesce(F.col("_bin") * 45.0, F.col("bearing_deg"), F.col("cog"), F.lit(0.0)) + 180.0, F.lit(360.0))
            picked = there.withColumns({"bearing_deg": F.round(back, 3), "turn_rate_deg_per_min": F.lit(45.0), "sog": F.greatest("sog", F.lit(3.0))}).drop("_c", "_bin")
        elif kind == "unexpected_stop":
            picked = picked.withColumns({"sog": F.lit(0.1), "accel_kn_per_min": F.lit(-4.0), "turn_rate_deg_per_min": F.lit(45.0)})
        out = picked if out is None else out.unionByName(picked)
    return out


def injection_metrics(scored: DataFrame, least: float = 0.35) -> DataFrame:
    """Recall of each kind, which for the controls is the false positive rate; mean score, the five commonest reasons (of equally common ones the first by name), and how many were left out."""
    used = scored.where("_skipped = 0")
    hit = F.count_if(F.col("anomaly_score") >= least)
    rates = used.groupBy("injection").agg(F.count("*").alias("evaluated"), hit.alias("detected"), F.round(hit / F.count("*"), 6).alias("rate"), F.round(F.avg("anomaly_score"), 6).alias("mean_score"))
    named = used.select("injection", F.explode(F.split("reasons", ";")).alias("reason")).where("reason <> ''").groupBy("injection", "reason").agg(F.count("*").alias("n"))
    top = named.groupBy("injection").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason"))).alias("_r"))  # a row for each indicator
    top = top.select("injection", F.transform(F.slice("_r", 1, 5), lambda x: F.concat(x["reason"], F.lit("="), (-x["m"]).cast("string"))).alias("top_reasons"))
    left = scored.groupBy("injection").agg(F.sum("_skipped").alias("skipped"))
    none = F.array().cast("array<string>")
    return left.join(rates, "injection", "left").join(top, "injection", "left").select(
        "injection", F.coalesce("evaluated", F.lit(0)).alias("evaluated"), F.coalesce("detected", F.lit(0)).alias("detected"), F.coalesce("rate", F.lit(0.0)).alias("rate"),
        F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"), F.coalesce("top_reasons", none).alias("top_reasons"), "skipped",
    )
