"""Cards for review: cases, hotspots and encounters without identities, and the checks they have to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.geo import plane
from .behavior import WEIGHTS

#: What is said of an encounter in public.
STATUS = ("insufficient_common_future_coverage", "geometrically_supported_within_0_5_nm", "geometrically_supported_within_1_0_nm_only", "observable_without_1_0_nm_geometric_support")


def _tracks(points: DataFrame) -> DataFrame:
    counts = F.map_from_arrays(F.array(*map(F.lit, WEIGHTS)), F.array(*[F.sum(k).cast("bigint") for k in WEIGHTS]))
    return points.groupBy("date", "mmsi", "track_id").agg(F.count("*").alias("points"), F.round(F.avg("anomaly_score"), 6).alias("mean_score"), F.max("anomaly_score").alias("max_score"), counts.alias("reason_counts"))


def select_cases(points: DataFrame, n: int = 7, reasons: tuple[str, ...] = tuple(WEIGHTS)) -> DataFrame:
    """For each reason in turn the track that shows it most, of vessels not yet chosen if there are any; then the fullest tracks of other vessels.

    At most ``n`` cases are chosen, so the best ``n`` tracks of a reason, its best ``n`` vessels, and the best ``2 n`` vessels of all decide: only
    those rows reach the driver.
    """
    tracks = _tracks(points).withColumn("mixed", F.lit("")).select("*", F.explode(F.array(F.lit(""), *map(F.lit, reasons))).alias("reason"))
    tracks = tracks.withColumn("count", F.when(F.col("reason") == "", F.col("points")).otherwise(F.element_at("reason_counts", F.col("reason")))).where("count > 0")
    order = [F.desc("count"), F.desc("mean_score"), F.desc("points"), "date", "track_id"]
    ranked = tracks.withColumn("_all", F.row_number().over(Window.partitionBy("reason").orderBy(*order))).withColumn("_own", F.row_number().over(Window.partitionBy("reason", "mmsi").orderBy(*order)))
    best = ranked.withColumn("_vessel", F.row_number().over(Window.partitionBy("reason", F.col("_own") == 1).orderBy(*order)))
    few = best.where((F.col("_all") <= n) | ((F.col("_own") == 1) & (F.col("_vessel") <= 2 * n))).select("reason", "_all", "date", "mmsi", "track_id", "points", "mean_score", "max_score", "reason_counts").orderBy("reason", "_all").collect()
    chosen, keys, vessels = [], set(), set()

    def take(r: Row, why: str) -> None:
        keys.add((r["date"], r["track_id"]))
        vessels.add(r["mmsi"])
        chosen.append((len(chosen) + 1, why, r["date"], r["mmsi"], r["track_id"], r["points"], r["mean_score"], r["max_score"]))

    for why in reasons:
        free = [r for r in few if r["reason"] == why and (r["date"], r["track_id"]) not in keys]
        pick = next((r for r in free if r["mmsi"] not in vessels), free[0] if free else None)
        if pick is not None and len(chosen) < n:
            take(pick, why)
    for r in few:
        if r["reason"] == "" and len(chosen) < n and r["mmsi"] not in vessels:
            take(r, max(reasons, key=lambda k: r["reason_counts"][k]))
    return points.sparkSession.createDataFrame(chosen, "case_no int, case_reason string, date string, mmsi string, track_id string, points bigint, mean_score double, max_score double")


def hotspot_cards(hot: DataFrame, types: DataFrame, backtest: DataFrame) -> DataFrame:
    """A card for each hotspot, the best first: what it holds, of what kind it is, and what became of its episodes. A grid bounds the cells."""
    seen = backtest.groupBy("cell_id").agg(F.count("*").alias("episodes"), F.sum("supported").alias("supported_episodes"))
    kinds = types.select("cell_id", "hotspot_type", "dominant_evidence", "stability_class", "anomaly_share", "encounter_share", "density_days", "fused_days")
    rank = F.row_number().over(Window.partitionBy("is_hotspot").orderBy(F.desc("risk_score"), "cell_id"))
    rows = hot.where("is_hotspot = 1").withColumn("rank", rank).join(kinds, "cell_id", "left").join(seen, "cell_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        F.format_string("hotspot_card_%03d", "rank").alias("card_id"), "rank", "cell_id", "risk_score", "hotspot_type", "dominant_evidence", "stability_class", "point_count", "moving_count", "anomaly_count", "low_support_count", "encounter_count",
        zero("episodes"), zero("supported_episodes"), "anomaly_share", "encounter_share", "density_days", "fused_days",
    )


def public_status() -> Column:
    c = F.col
    return F.when(c("observable") == 0, STATUS[0]).when(c("supported") == 1, STATUS[1]).when(c("near_supported") == 1, STATUS[2]).otherwise(STATUS[3])


def best_episodes(backtest: DataFrame, n: int = 12, prefix: str = "enc") -> DataFrame:
    """The episodes that can be judged best, with ``rank`` and ``case_id``. The order ends in the episode's own key, so there are no ties; the limit is the sample's own."""
    order = [F.desc("observable"), F.desc("supported"), F.desc(F.col("actual_min_nm").isNotNull()), F.desc("coverage_s"), F.desc("first_score"), "date", "mmsi_a", "mmsi_b", "t0"]
    number = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order))  # n rows
    return backtest.orderBy(*order).limit(n).withColumn("rank", number).withColumn("case_id", F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("rank").cast("string"), 3, "0")))


def encounter_cards(backtest: DataFrame, records: DataFrame, n: int = 12, prefix: str = "enc", window_s: int = 900) -> DataFrame:
    """The best episodes with positions relative to their middle at t0: no names, no times, no places."""
    states = records.select("mmsi_a", "mmsi_b", F.col("g").alias("t0"), "lon_a", "lat_a", "lon_b", "lat_b")
    met = best_episodes(backtest, n, prefix).join(states, ["mmsi_a", "mmsi_b", "t0"])
    c = F.col
    (ax, ay), (bx, by) = (plane(c(f"lon_{s}"), c(f"lat_{s}"), c("lon_mid"), c("lat_mid")) for s in "ab")
    r = lambda x: F.round(x, 4)
    return met.select(
        "case_id", "rank", public_status().alias("support_status"), "current_distance_nm", "dcpa_nm", "tcpa_min", r(ax).alias("x_a_nm"), r(ay).alias("y_a_nm"), r(bx).alias("x_b_nm"), r(by).alias("y_b_nm"),
        "actual_min_nm", "coverage_s", F.lit(window_s).alias("window_s"), F.round(c("coverage_s") / window_s, 6).alias("coverage_fraction"), "record_count",
    )


def card_problems(cards: DataFrame, tolerance_nm: float = 0.05) -> DataFrame:
    """Cards whose numbers contradict each other; there must be none."""
    c = F.col
    apart = F.hypot(c("x_b_nm") - c("x_a_nm"), c("y_b_nm") - c("y_a_nm"))
    rules = {
        "distance": c("current_distance_nm").isNull() | (c("current_distance_nm") < 0), "geometry": F.abs(apart - c("current_distance_nm")) > tolerance_nm,
        "approach": (c("tcpa_min") > 0) & (c("dcpa_nm") > c("current_distance_nm") + tolerance_nm), "window": ~(c("window_s") > 0) | (c("coverage_s") > c("window_s")),
    }
    return cards.withColumn("problems", F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(k == "geometry")), k) for k, v in rules.items()]))).where(F.size("problems") > 0)


def bundle_checks(points: DataFrame, hot: DataFrame, episodes: DataFrame, backtest: DataFrame, records: DataFrame) -> DataFrame:
    """Whether counts agree across outputs: name, both counts, whether they are equal."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    pairs = {
        "episodes_backtested": (n(episodes, "a"), n(backtest, "b")),
        "episode_records": (episodes.agg(F.coalesce(F.sum("record_count"), F.lit(0)).alias("a")), n(records.where("is_candidate = 1"), "b")),
        "anomalies_in_cells": (n(points.where(F.col("cell_id").isNotNull()), "a"), hot.agg(F.coalesce(F.sum("anomaly_count"), F.lit(0)).alias("b"))),
        "encounters_in_cells": (n(records.where("is_candidate = 1 AND cell_id IS NOT NULL"), "a"), hot.agg(F.coalesce(F.sum("encounter_count"), F.lit(0)).alias("b"))),
        "supported_are_observable": (n(backtest.where("supported = 1"), "a"), n(backtest.where("supported = 1 AND observable = 1"), "b")),
    }
    out = None
    for name, (a, b) in pairs.items():
        one = a.crossJoin(F.broadcast(b)).select(F.lit(name).alias("check"), F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), (F.col("a") == F.col("b")).alias("ok"))
        out = one if out is None else out.unionByName(one)
    return out
