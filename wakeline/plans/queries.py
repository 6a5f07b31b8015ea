"""Named queries over whole tables, each with its SQL twin where there is one."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BAY, Encounter, Future, Hotspot, PatternGates
from ..operators import assessment, behavior, cards, controls, encounters, future, publish, quality, ranking, raster, report, tracks
from ..shared import forget, stamp, written
from ..sources.events import reports
from . import oracle
from .oracle import sql

#: The view has few points a cell, so patterns get lower gates here.
GATES = PatternGates(min_points=oracle.PATTERN_POINTS, min_tracks=oracle.PATTERN_TRACKS)
SOG_EDGES = [0.0, 0.5, 1.0, 3.0, 6.0, 10.0, 15.0, 20.0, 30.0]
LENGTH_EDGES = [1, 2, 3, 5, 10, 20, 50, 100, 200]
FIELDS = ["mmsi", "base_date_time", "longitude", "latitude", "sog", "cog", "heading", "vessel_type", "length", "width", "draft"]
NUMERIC = ["longitude", "latitude", "sog", "cog", "heading", "length", "width", "draft"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


_SHARED: dict[tuple, DataFrame] = {}


def shared(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Results that many queries build on are written to the shared folder, once for each state of the input's files: plans stay small and compute them once."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str, *more: object) -> DataFrame:
        key = (spark.sparkContext.applicationId, f.__name__, sf_dir, stamp(spark, f"{sf_dir}/events.parquet"), more)
        if key not in _SHARED:
            _SHARED[key] = written(f(spark, sf_dir, *more))
        return _SHARED[key]

    return run


def forget_all() -> None:
    """Delete the written results, so that the next query computes its own."""
    for df in _SHARED.values():
        forget(df)
    _SHARED.clear()


def query(name: str, twin: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if twin:
            ORACLE_SQL[name] = twin
        return f

    return add


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(reports(spark, sf_dir), BAY)


@shared
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.features(cleaned(spark, sf_dir))


@shared
def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.patterns(features(spark, sf_dir), BAY, GATES)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.score(features(spark, sf_dir), patterns(spark, sf_dir), BAY)


@shared
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behavior.candidates(scored(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounters.causal_grid(features(spark, sf_dir))


@shared
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounters.opportunities(encounters.pairs_within(states(spark, sf_dir), 2.0), BAY)


def _as(name: str, f: Callable, twin: str | None, *columns: str) -> None:
    query(name, twin)(lambda s, d: f(s, d).select(*columns) if columns else f(s, d))


_CLEAN = ["ordinal", *FIELDS]
_as("crop_bbox", lambda s, d: quality.crop(reports(s, d), BAY), sql(f"SELECT {', '.join(_CLEAN)} FROM raw WHERE {oracle.inside('longitude', 'latitude')}"), *_CLEAN)
_as("crop_counters", lambda s, d: quality.crop_counters(reports(s, d), BAY), sql(f"SELECT count(*) AS total, count(*) FILTER (WHERE i) AS kept, count(*) FILTER (WHERE longitude IS NULL OR latitude IS NULL) AS invalid_position, count(*) FILTER (WHERE NOT i) AS outside, min(base_date_time) FILTER (WHERE i) AS first_time, max(base_date_time) FILTER (WHERE i) AS last_time FROM (SELECT *, {oracle.inside('longitude', 'latitude')} AS i FROM raw)"))
_as("clean_rows", cleaned, sql(f"SELECT {', '.join(_CLEAN)} FROM cleaned"), *_CLEAN)
_as("clean_counters", lambda s, d: quality.clean_counters(reports(s, d), BAY), sql("SELECT coalesce(drop_reason, 'kept') AS outcome, count(*) AS n FROM classified GROUP BY 1"))
_as("audit_missing", lambda s, d: quality.audit_missing(cleaned(s, d), FIELDS), sql(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (WHERE {c} IS NULL) AS n_null, round({oracle.D(100)} * count(*) FILTER (WHERE {c} IS NULL) / count(*), 4) AS pct_null FROM cleaned" for c in FIELDS)))
_as("audit_numeric", lambda s, d: quality.audit_numeric(cleaned(s, d), NUMERIC), sql(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS n, min(v) AS least, round(avg(v), 6) AS mean, max(v) FILTER (WHERE i = k // 2) AS p50, max(v) FILTER (WHERE i = CAST(floor((k - 1) * {oracle.D(0.95)}) AS BIGINT)) AS p95, max(v) AS most FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS i, count(*) OVER () AS k FROM cleaned WHERE {c} IS NOT NULL)" for c in NUMERIC)))
_as("audit_summary", lambda s, d: quality.audit_summary(reports(s, d)), sql("""
SELECT count(*) AS n_rows, count(DISTINCT mmsi) AS unique_mmsi, min(base_date_time) AS first_time, max(base_date_time) AS last_time, count(*) FILTER (WHERE longitude IS NULL OR latitude IS NULL) AS missing_position,
  count(*) FILTER (WHERE NOT (longitude BETWEEN -180 AND 180 AND latitude BETWEEN -90 AND 90)) AS position_outside_world, count(*) FILTER (WHERE sog IS NULL) AS missing_sog, count(*) FILTER (WHERE sog < 0) AS negative_sog,
  count(*) FILTER (WHERE sog > 60) AS sog_gt_60_kn, count(*) FILTER (WHERE cog IS NULL) AS missing_cog, count(*) FILTER (WHERE cog < 0 OR cog >= 360) AS cog_outside_0_360, count(*) FILTER (WHERE heading IS NULL) AS missing_heading,
  count(*) FILTER (WHERE heading = 511 OR NOT heading BETWEEN 0 AND 360) AS invalid_heading FROM raw"""))
_as("audit_top", lambda s, d: quality.audit_top(cleaned(s, d), "vessel_type"), sql("SELECT vessel_type AS value, count(*) AS n FROM cleaned GROUP BY 1 ORDER BY n DESC, value LIMIT 20"))
_FEAT = ["ordinal", "date", "mmsi", "track_id", "point_index", "segment_break_reason", "time_gap_s", "distance_gap_nm", "implied_sog_kn", "bearing_deg", "bearing_delta_deg", "sog_delta_kn", "accel_kn_per_min", "turn_rate_deg_per_min"]
_as("motion_features", features, sql(f"SELECT {', '.join(_FEAT)} FROM feat"), *_FEAT)
_as("segments", lambda s, d: features(s, d).groupBy("segment_break_reason").agg(F.count("*").alias("n"), F.count_distinct("mmsi").alias("vessels")), sql("SELECT segment_break_reason, count(*) AS n, count(DISTINCT mmsi) AS vessels FROM feat GROUP BY 1"))
_as("min_tracks", lambda s, d: tracks.long_tracks(features(s, d), 20), sql("SELECT ordinal, date, track_id, track_points FROM (SELECT *, count(*) OVER (PARTITION BY date, track_id) AS track_points FROM feat) WHERE track_points >= 20"), "ordinal", "date", "track_id", "track_points")
_hist = lambda expr, src, edges: sql(f"SELECT e.bin, count(b.bin) AS n FROM (SELECT CAST(unnest(range({len(edges)})) AS INT) AS bin) e LEFT JOIN (SELECT CASE {' '.join(f'WHEN {expr} >= {x} THEN {i}' for i, x in reversed([*enumerate(edges)]))} END AS bin FROM {src}) b USING (bin) GROUP BY 1")
_as("sog_hist", lambda s, d: tracks.binned(cleaned(s, d), F.col("sog"), SOG_EDGES), _hist("sog", "cleaned", SOG_EDGES))
_as("track_len_hist", lambda s, d: tracks.binned(features(s, d).groupBy("date", "track_id").count(), F.col("count"), LENGTH_EDGES), _hist("k", "(SELECT count(*) AS k FROM feat GROUP BY date, track_id)", LENGTH_EDGES))
_as("grid_density", lambda s, d: raster.density(features(s, d), BAY), sql("SELECT * FROM density"))
_as("raster_bins", lambda s, d: raster.bins(cleaned(s, d), BAY), sql(f"""
SELECT least(CAST(floor((longitude - {oracle.D(BAY.west)}) / ({oracle.D(BAY.east)} - {oracle.D(BAY.west)}) * 120) AS INT), 119) AS x, least(CAST(floor(({oracle.D(BAY.north)} - latitude) / ({oracle.D(BAY.north)} - {oracle.D(BAY.south)}) * 120) AS INT), 119) AS y, count(*) AS n
FROM cleaned WHERE {oracle.inside('longitude', 'latitude')} GROUP BY 1, 2"""))
_as("density_norm", lambda s, d: raster.density_norm(raster.density(features(s, d), BAY, "date")), sql("SELECT cell_id, point_count, moving_count, track_days, round(point_count / CAST(max(point_count) OVER () AS DOUBLE), 6) AS density_norm FROM (SELECT cell_id, CAST(sum(point_count) AS BIGINT) AS point_count, CAST(sum(moving_count) AS BIGINT) AS moving_count, CAST(sum(unique_tracks) AS BIGINT) AS track_days FROM daily_density GROUP BY cell_id)"))
_as("patterns", patterns, sql("SELECT * FROM patterns"))
_as("pattern_thresholds", lambda s, d: raster.thresholds(raster.moving_cells(features(s, d), BAY, GATES), GATES), sql("SELECT CAST(normal_threshold AS BIGINT) AS normal_threshold, CAST(high_threshold AS BIGINT) AS high_threshold FROM gates"))
_POINT = ["ordinal", "date", "mmsi", "track_id", "cell_id", "anomaly_score", "reasons", "indicator_count", "evidence_tier"]
_as("anomaly_points", points, sql(f"SELECT {', '.join(_POINT)} FROM points"), *_POINT)
_as("anomaly_counters", lambda s, d: behavior.counters(points(s, d)), sql("SELECT evidence_tier AS name, count(*) AS n, 'tier' AS kind FROM points GROUP BY 1 UNION ALL SELECT name, count(*), 'reason' FROM (SELECT unnest(string_split(reasons, ';')) AS name FROM points) GROUP BY 1"))
_as("behaviour_targets", lambda s, d: behavior.targets(points(s, d)), sql("SELECT * FROM targets"))
_as("direction_audit", lambda s, d: behavior.direction_audit(features(s, d)), sql(f"SELECT count(*) AS moving_rows, count(a) AS derived_available, count(b) AS cog_available, count(d) AS both_available, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS cog_fallback, count(*) FILTER (WHERE a IS NULL AND b IS NULL) AS no_direction, count(*) FILTER (WHERE {oracle.sector('a')} = {oracle.sector('b')}) AS same_bin, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.95), 6) AS p95, count(*) FILTER (WHERE d <= 22.5) AS within_22_5, count(*) FILTER (WHERE d <= 45) AS within_45 FROM (SELECT bearing_deg AS a, cog AS b, {oracle.delta('bearing_deg', 'cog')} AS d FROM feat WHERE sog >= 1)"))
_as("case_tracks", lambda s, d: behavior.case_tracks(points(s, d)), sql(f"SELECT date, mmsi, track_id, count(*) AS points, round(avg(anomaly_score), 6) AS mean_score, max(anomaly_score) AS max_score, min(sog) AS min_sog, max(sog) AS max_sog, {', '.join(f'CAST(sum({k}) AS BIGINT) AS n_{k}' for k in oracle.WEIGHTS)} FROM points GROUP BY 1, 2, 3 ORDER BY points DESC, max_score DESC, date, track_id LIMIT 7"))
_as("injections", lambda s, d: behavior.injection_metrics(behavior.score(written(behavior.inject(features(s, d), patterns(s, d), BAY)), patterns(s, d), BAY)), None)
_STATE = "g, mmsi, t, round(lon, 6) AS lon, round(lat, 6) AS lat, sog, course, direction_source, track_id, age_s"
_as("causal_grid", lambda s, d: states(s, d).withColumns({"lon": F.round("lon", 6), "lat": F.round("lat", 6)}), sql(f"SELECT {_STATE} FROM states"))
_as("pairs_within", lambda s, d: encounters.pairs_within(states(s, d), 2.0), sql("SELECT g, mmsi_a, mmsi_b FROM pairs"), "g", "mmsi_a", "mmsi_b")
_as("pairs_brute", lambda s, d: encounters.pairs_brute(states(s, d), 2.0), sql("SELECT g, mmsi_a, mmsi_b FROM pairs"), "g", "mmsi_a", "mmsi_b")
_OPP = ["date", "g", "mmsi_a", "mmsi_b", "state_skew_s", "age_s_a", "age_s_b", "lon_a", "lon_b", "lat_a", "lat_b", "sog_a", "sog_b", "course_a", "course_b", "track_id_a", "track_id_b", "cell_id", "current_distance_nm", "dcpa_nm", "tcpa_min", "relative_speed_kn", "closing_speed_kn", "is_candidate", "encounter_score"]
_as("opportunity_records", records, sql(f"SELECT {', '.join(_OPP)} FROM opps"), *_OPP)
_as("encounters", lambda s, d: records(s, d).where("is_candidate = 1"), sql(f"SELECT {', '.join(_OPP)} FROM opps WHERE is_candidate = 1"), *_OPP)
_as("opportunities", lambda s, d: encounters.exposure(records(s, d)), sql("SELECT * FROM exposure"))
_EPISODE = ["date", "mmsi_a", "mmsi_b", "t0", "end_s", "record_count", "dcpa_nm", "tcpa_min", "first_score", "current_distance_nm", "state_skew_s", "lon_mid", "lat_mid", "max_score", "min_dcpa_nm", "min_distance_nm"]
_as("episodes", lambda s, d: encounters.episodes(records(s, d)), sql(f"SELECT {', '.join(_EPISODE)} FROM episodes"), *_EPISODE)
_as("encounter_summary", lambda s, d: encounters.summary(records(s, d)), sql("SELECT count(*) AS candidates, count(DISTINCT mmsi_a || '|' || mmsi_b) AS pairs, count(DISTINCT date || mmsi_a || mmsi_b) AS pair_days, count(DISTINCT date || mmsi_a || mmsi_b || island) AS episodes FROM islands"))


#: At small scale the default rule can judge no episode, so a relaxed one stands beside it.
RELAXED = Future(min_fraction=0.30, max_uncovered_s=600)
SPOTS = Hotspot(min_points=20, min_moving=5, min_anomalies=3, min_encounters=3)


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encounters.episodes(records(spark, sf_dir))


@shared
def backtest(spark: SparkSession, sf_dir: str, u: Future = Future()) -> DataFrame:
    return future.backtest(episodes(spark, sf_dir), features(spark, sf_dir), u)


@shared
def evidence(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    r = records(spark, sf_dir)
    return ranking.evidence(points(spark, sf_dir), r, encounters.exposure(r), raster.density(features(spark, sf_dir), BAY, *keys), SPOTS, *keys)


@shared
def hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hotspots(evidence(spark, sf_dir), SPOTS)


@shared
def stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stability(evidence(spark, sf_dir, "date"))


@shared
def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = behavior.targets(points(spark, sf_dir)).select(F.lit("behavior").alias("kind"), "cell_id", "date")
    met = backtest(spark, sf_dir, RELAXED).where("supported = 1 AND cell_id IS NOT NULL").select(F.lit("encounter").alias("kind"), "cell_id", "date")
    return seen.unionByName(met)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_evaluation(hot(spark, sf_dir).where("eligible = 1"), targets(spark, sf_dir))


@shared
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of the table, each of which is a fold."""
    return features(spark, sf_dir).select(F.col("date").alias("fold")).distinct()


@shared
def fold_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of all days but one, for each day."""
    train = features(spark, sf_dir).crossJoin(F.broadcast(dates(spark, sf_dir))).where("date <> fold")
    return raster.patterns(train, BAY, GATES, "fold")


@shared
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day of the table is held out in turn. The fold is a column, so all folds are one plan; patterns and evidence come from the other days alone."""
    f, every = features(spark, sf_dir), dates(spark, sf_dir)
    train = f.crossJoin(F.broadcast(every)).where("date <> fold")
    known = fold_patterns(spark, sf_dir)
    r = records(spark, sf_dir).select("date", "cell_id", "is_candidate", "encounter_score").crossJoin(F.broadcast(every)).where("date <> fold")
    exposure = r.where("cell_id IS NOT NULL").groupBy("fold", "cell_id").agg(F.count("*").alias("pair_opportunity_count"))
    e = ranking.evidence(behavior.candidates(behavior.score(train, known, BAY, "fold")), r, exposure, raster.density(train, BAY, "fold"), SPOTS, "fold")
    cells = written(ranking.with_components(e.where("is_evidence > 0 AND point_count >= 20 AND moving_count >= 5 AND (anomaly_count >= 3 OR encounter_count >= 3)")))
    out = behavior.targets(behavior.candidates(behavior.score(f.withColumn("fold", F.col("date")), known, BAY, "fold"))).select(F.lit("behavior").alias("kind"), "cell_id", F.col("date").alias("fold"))
    met = backtest(spark, sf_dir, RELAXED).where((F.col("supported") == 1) & F.col("cell_id").isNotNull()).select(F.lit("encounter").alias("kind"), "cell_id", F.col("date").alias("fold"))
    return ranking.rank_evaluation(cells, out.unionByName(met), ranking.METHODS, (0.05, 0.10, 0.20), True, "fold")


@shared
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.anchors(records(spark, sf_dir))


@shared
def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return controls.match(anchors(spark, sf_dir))


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = anchors(spark, sf_dir)
    later = future.backtest(a.select("date", "mmsi_a", "mmsi_b", F.col("g").alias("t0"), "anchor_id", "dcpa_nm", "tcpa_min"), features(spark, sf_dir), RELAXED)
    return controls.outcomes(matched(spark, sf_dir), later)


_BACK = ["date", "mmsi_a", "mmsi_b", "t0", "coverage_s", "uncovered_s", "samples", "observations_a", "observations_b", "actual_min_nm", "observable_50", "observable", "observable_90", "supported", "near_supported", "status", "distance_error_nm"]
_as("backtest", backtest, sql(f"SELECT {', '.join(_BACK)} FROM backtest"), *_BACK)
_as("backtest_relaxed", lambda s, d: backtest(s, d, RELAXED), sql(f"SELECT {', '.join(_BACK)} FROM relaxed"), *_BACK)
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("observable", "supported", "near_supported", "observable_50", "observable_90"))
_summary = lambda t: sql(f"SELECT *, round(CAST(observable AS DOUBLE) / episodes, 6) AS observable_rate, round(CAST(supported AS DOUBLE) / nullif(observable, 0), 6) AS support_rate, round(CAST(near_supported AS DOUBLE) / nullif(observable, 0), 6) AS near_rate FROM (SELECT count(*) AS episodes, {_SUMS}, round(quantile_cont(CAST(coverage_s AS DOUBLE), 0.5), 6) AS median_coverage_s, round(quantile_cont(distance_error_nm, 0.5), 6) AS median_distance_error_nm, round(quantile_cont(distance_error_nm, 0.9), 6) AS p90_distance_error_nm FROM {t})")
_as("backtest_summary", lambda s, d: future.backtest_summary(backtest(s, d, RELAXED)), _summary("relaxed"))
_as("backtest_status", lambda s, d: future.backtest_status(backtest(s, d, RELAXED)), sql("""
SELECT status, count(*) AS episodes, round(quantile_cont(CAST(coverage_s AS DOUBLE), 0.1), 6) AS p10_coverage_s, round(quantile_cont(CAST(coverage_s AS DOUBLE), 0.5), 6) AS median_coverage_s, round(quantile_cont(CAST(coverage_s AS DOUBLE), 0.75), 6) AS p75_coverage_s,
  round(quantile_cont(distance_error_nm, 0.75), 6) AS p75_distance_error_nm, min(actual_min_nm) AS least_actual_nm FROM relaxed GROUP BY status"""))
_NEAREST = ["date", "mmsi_a", "mmsi_b", "t0", "actual_min_nm", "dcpa_nm", "coverage_s"]
_as("backtest_examples", lambda s, d: future.backtest_examples(backtest(s, d, RELAXED)), sql(f"SELECT {', '.join(_NEAREST)} FROM relaxed WHERE supported = 1 ORDER BY actual_min_nm, date, mmsi_a, mmsi_b, t0 LIMIT 10"), *_NEAREST)
_as("future_min", lambda s, d: backtest(s, d).where("actual_min_nm IS NOT NULL"), sql("SELECT date, mmsi_a, mmsi_b, t0, actual_min_nm FROM judged WHERE actual_min_nm IS NOT NULL"), "date", "mmsi_a", "mmsi_b", "t0", "actual_min_nm")
_as("coverage", lambda s, d: backtest(s, d).where("coverage_s > 0"), sql("SELECT date, mmsi_a, mmsi_b, t0, coverage_s, uncovered_s FROM judged WHERE coverage_s > 0"), "date", "mmsi_a", "mmsi_b", "t0", "coverage_s", "uncovered_s")
_as("grid_sensitivity", lambda s, d: future.grid_sensitivity(episodes(s, d), features(s, d)), sql("SELECT z.step_s, count(*) AS samples, count(DISTINCT {'a': date, 'b': mmsi_a, 'c': mmsi_b, 'd': t0}) AS episodes, round(min(d), 6) AS least_nm FROM (SELECT * FROM samples) JOIN (VALUES (10), (30), (60)) z(step_s) ON k * 10 % z.step_s = 0 GROUP BY 1"))
_STRATA = ["date", "g", "mmsi_a", "mmsi_b", "hour_block", "block_x", "block_y", "band", "local_exposure", "tertile"]
_as("strata", lambda s, d: controls.strata(records(s, d)), sql(f"SELECT {', '.join(_STRATA)} FROM strata"), *_STRATA)
_as("cohorts", lambda s, d: anchors(s, d).groupBy("anchor_type").agg(F.count("*").alias("n"), F.sum("record_count").alias("records")), sql("SELECT 'candidate' AS anchor_type, count(*) AS n, CAST(sum(record_count) AS BIGINT) AS records FROM episodes UNION ALL SELECT 'control', count(*), count(*) FROM picked"))
_as("thinned", lambda s, d: anchors(s, d).where("anchor_type = 'control'"), sql("SELECT mmsi_a, mmsi_b, g FROM picked"), "mmsi_a", "mmsi_b", "g")
_as("matches", matched, None)
_as("balance", lambda s, d: controls.balance(anchors(s, d), matched(s, d), judged_anchors(s, d)), None)
_as("match_observability", lambda s, d: controls.observability(matched(s, d), judged_anchors(s, d)), None)
_as("outcomes", outcome, None)
_as("match_components", lambda s, d: controls.dependence(matched(s, d)).groupBy("root").agg(F.count("*").alias("nodes")), None)
_HOT = ["cell_id", "anomaly_count", "low_support_count", "encounter_count", "opportunities", "point_count", "moving_count", "anomaly_component", "encounter_component", "eligible", "risk_score", "is_hotspot"]
_as("hotspots", hot, sql(f"SELECT {', '.join(f'CAST({c} AS BIGINT) AS {c}' if c in _HOT[1:7] else c for c in _HOT)} FROM hot"), *_HOT)
_as("stability", stable, sql("SELECT * FROM stable"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dates(spark, sf_dir).count()
    return ranking.typology(hot(spark, sf_dir), stable(spark, sf_dir), ranking.main_reasons(points(spark, sf_dir)), days)


def _case(*parts: object) -> str:
    """Conditions and texts in turn, then the text for all else."""
    quoted = lambda x: f"'{x}'"
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(v)}" for c, v in zip(parts[:-1:2], parts[1::2], strict=True)) + f" ELSE {quoted(parts[-1])} END"


_KIND = _case(
    "anomaly_count > 0 AND encounter_count > 0 AND anomaly_share >= 0.65", ranking.EVIDENCE[0], "anomaly_count > 0 AND encounter_count > 0 AND encounter_share >= 0.65", ranking.EVIDENCE[1],
    "anomaly_count > 0 AND encounter_count > 0", ranking.EVIDENCE[2], "anomaly_count > 0", ranking.EVIDENCE[3], "encounter_count > 0", ranking.EVIDENCE[4], ranking.EVIDENCE[5],
)
_STEADY = _case(
    "density_days >= need AND fused_days >= need", ranking.STEADY[0], "density_days >= need", ranking.STEADY[1], "fused_days >= need", ranking.STEADY[2],
    "is_hotspot = 1 AND (fused_days > 0 OR density_percentile < 0.75)", ranking.STEADY[3], "density_percentile >= 0.9", ranking.STEADY[4], ranking.STEADY[5],
)
_TYPE = _case(
    "is_hotspot = 0 AND density_percentile >= 0.9", ranking.TYPES[0], "is_hotspot = 0", ranking.TYPES[1], "contains(stability_class, 'stable traffic-exposure')", ranking.TYPES[2],
    "contains(stability_class, 'persistent candidate')", ranking.TYPES[3], "contains(stability_class, 'event-sensitive')", ranking.TYPES[4], "contains(dominant_evidence, 'encounter-dominated')", ranking.TYPES[5],
    "contains(dominant_evidence, 'anomaly-dominated')", ranking.TYPES[6], ranking.TYPES[7],
)
_FOCUS = f"""CASE WHEN contains(stability_class, 'stable traffic-exposure') THEN '{ranking.FOCUS[0]}' WHEN contains(dominant_evidence, 'encounter-dominated') THEN '{ranking.FOCUS[1]}'
  WHEN contains(dominant_evidence, 'anomaly-dominated') THEN '{ranking.FOCUS[2][0]}' || coalesce(replace(dominant_reason, '_', ' '), '{ranking.FOCUS[2][1]}') || '.' WHEN contains(dominant_evidence, 'balanced') THEN '{ranking.FOCUS[3]}'
  WHEN dominant_reason IS NOT NULL THEN '{ranking.FOCUS[4][0]}' || replace(dominant_reason, '_', ' ') || '{ranking.FOCUS[4][1]}' ELSE '{ranking.FOCUS[5]}' END"""
_SHARES = f"anomaly_component, CAST(0.75 AS DOUBLE) * encounter_component AS w, anomaly_component + {oracle.D(0.75)} * encounter_component AS whole"
_TYPED = f"""
SELECT *, {_TYPE} AS hotspot_type, {_FOCUS} AS review_focus FROM (SELECT * EXCLUDE (need, anomaly_count, encounter_count), {_KIND} AS dominant_evidence, {_STEADY} AS stability_class FROM (
  SELECT h.cell_id, h.is_hotspot, h.density_percentile, coalesce(round(h.anomaly_component / nullif(h.whole, 0), 6), 0) AS anomaly_share, coalesce(round(h.w / nullif(h.whole, 0), 6), 0) AS encounter_share,
    coalesce(k.density_days, 0) AS density_days, coalesce(k.fused_days, 0) AS fused_days, r.reason AS dominant_reason, h.anomaly_count, h.encounter_count, greatest(3, round_even((SELECT count(DISTINCT date) FROM feat) * 0.5, 0)) AS need
  FROM (SELECT *, {_SHARES}, round(1 - (row_number() OVER (ORDER BY point_count DESC, cell_id) - 1) / CAST(greatest(1, count(*) OVER () - 1) AS DOUBLE), 6) AS density_percentile FROM hot) h
  LEFT JOIN (SELECT cell_id, count(*) FILTER (WHERE method = 'density_only') AS density_days, count(*) FILTER (WHERE method = 'fused_risk') AS fused_days FROM (SELECT method, unnest(top_cells) AS cell_id FROM stable) GROUP BY cell_id) k USING (cell_id)
  LEFT JOIN (SELECT cell_id, reason FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY n DESC, first) AS i FROM (
    SELECT cell_id, reason, count(*) AS n, min({{'o': ordinal, 'i': list_position(string_split(reasons, ';'), reason)}}) AS first FROM (SELECT *, unnest(string_split(reasons, ';')) AS reason FROM points) WHERE reason <> '' GROUP BY ALL)) WHERE i = 1) r USING (cell_id)))"""
_as("typology", typed, sql(_TYPED))
_TARGETS = "(SELECT 'behavior' AS kind, cell_id FROM targets UNION ALL SELECT 'encounter', cell_id FROM relaxed WHERE supported = 1 AND cell_id <> '')"


def _sets(methods: dict, table: str, *keys: str) -> str:
    """A row for each method and cell of a table."""
    k = "".join(f"{x}, " for x in keys)
    return " UNION ALL ".join(
        f"SELECT {k}'{m}' AS method, cell_id, round({oracle.D(a)} * point_count + {oracle.D(b)} * anomaly_component + {oracle.D(e)} * encounter_component, 8) AS score FROM {table}" for m, (a, b, e) in methods.items()
    )


def _chosen(methods: dict, table: str, up: bool, *keys: str) -> str:
    """The best cells of each method and budget."""
    k = "".join(f"{x}, " for x in keys)
    return f"""SELECT {k}method, budget, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY {k}method ORDER BY score DESC, cell_id) AS r, count(*) OVER (PARTITION BY {k}method) AS n FROM ({_sets(methods, table, *keys)}))
CROSS JOIN (VALUES ({oracle.D(0.05)}), ({oracle.D(0.1)}), ({oracle.D(0.2)})) b(budget) WHERE r <= greatest(1, {'ceil' if up else 'floor'}(n * budget))"""


def _captures(table: str, targets: str, *keys: str) -> str:
    k = "".join(f"{x}, " for x in keys)
    r = "".join(f"r.{x}, " for x in keys)
    on = "".join(f"x.{x} = r.{x} AND " for x in keys)
    of = on.replace("x.", "t.")
    total = f"(SELECT {k}kind, count(*) AS n FROM {targets} GROUP BY ALL)"
    return f"""SELECT {r}r.method, r.budget, z.kind, count(DISTINCT r.cell_id) AS selected_cells, count(x.cell_id) AS captured, coalesce(any_value(t.n), 0) AS targets, round(count(x.cell_id) / CAST(any_value(t.n) AS DOUBLE), 6) AS capture_rate
FROM ({_chosen(ranking.METHODS, table, True, *keys)}) r CROSS JOIN (VALUES ('behavior'), ('encounter')) z(kind)
LEFT JOIN {total} t ON {of}t.kind = z.kind LEFT JOIN {targets} x ON {on}x.kind = z.kind AND x.cell_id = r.cell_id GROUP BY {r}r.method, r.budget, z.kind"""


_ELIGIBLE = "(SELECT * FROM hot WHERE eligible = 1)"
_RANKED = _captures(_ELIGIBLE, _TARGETS)
_as("dual_full", ranked, sql(_RANKED))
_OBSERVED = f"(SELECT * FROM relaxed WHERE observable = 1 AND cell_id IN (SELECT cell_id FROM {_ELIGIBLE}))"
_as("rank_eval", lambda s, d: ranking.screening(hot(s, d).where("eligible = 1"), backtest(s, d, RELAXED)), sql(f"""
SELECT *, round(supported_episodes / CAST(nullif((SELECT sum(supported) FROM {_OBSERVED}), 0) AS DOUBLE), 6) AS capture_rate, round(CAST(supported_episodes AS DOUBLE) / nullif(observable_episodes, 0), 6) AS support_rate,
  round((CAST(supported_episodes AS DOUBLE) / nullif(observable_episodes, 0)) / nullif((SELECT CAST(sum(supported) AS DOUBLE) / count(*) FROM {_OBSERVED}), 0), 6) AS enrichment
FROM (SELECT r.method, r.budget, count(DISTINCT r.cell_id) AS selected_cells, count(x.cell_id) AS observable_episodes, CAST(coalesce(sum(x.supported), 0) AS BIGINT) AS supported_episodes
  FROM ({_chosen(ranking.SCREENING, _ELIGIBLE, False)}) r LEFT JOIN {_OBSERVED} x ON x.cell_id = r.cell_id GROUP BY r.method, r.budget)"""))
_NAMES = ", ".join(f"({i}, '{m}')" for i, m in enumerate(ranking.SCREENING))
_TENTH = f"(SELECT method, list(cell_id) AS c FROM ({_chosen(ranking.SCREENING, _ELIGIBLE, False)}) WHERE budget = {oracle.D(0.1)} GROUP BY method)"
_as("rank_overlap", lambda s, d: ranking.rank_overlap(hot(s, d).where("eligible = 1")), sql(f"""
SELECT a.m AS method_a, b.m AS method_b, round(len(list_intersect(x.c, y.c)) / CAST(len(list_distinct(list_concat(x.c, y.c))) AS DOUBLE), 6) AS overlap
FROM (VALUES {_NAMES}) a(i, m) JOIN (VALUES {_NAMES}) b(i, m) ON a.i < b.i JOIN {_TENTH} x ON x.method = a.m JOIN {_TENTH} y ON y.method = b.m"""))
_WIDE = f"(SELECT budget, method, max(captured) FILTER (WHERE kind = 'behavior') AS behavior, max(captured) FILTER (WHERE kind = 'encounter') AS encounter FROM ({_RANKED}) GROUP BY budget, method)"
_as("pareto", lambda s, d: ranking.pareto(written(ranked(s, d))), sql(f"""
SELECT * FROM {_WIDE} w WHERE NOT EXISTS (SELECT 1 FROM {_WIDE} o WHERE o.budget = w.budget AND o.behavior >= w.behavior AND o.encounter >= w.encounter AND (o.behavior > w.behavior OR o.encounter > w.encounter))"""))
_FOLD_CELLS = "(SELECT * FROM fold_evidence WHERE is_evidence > 0 AND point_count >= 20 AND moving_count >= 5 AND (anomaly_count >= 3 OR encounter_count >= 3))"
_FOLDS = _captures(_FOLD_CELLS, "fold_targets", "fold")
_as("lodo_folds", folds, sql(_FOLDS))
_PASSES = f"""SELECT fold, budget, CAST(fb > eb AND (ee = 0 OR fe >= 0.95 * ee) AS INT) AS passes, round(fe / nullif(ee, 0), 6) AS encounter_retention, round(fb - eb, 6) AS behavior_delta FROM (
  SELECT fold, budget, {', '.join(f"coalesce(max(capture_rate) FILTER (WHERE method = '{m}' AND kind = '{k}'), 0) AS {x}" for x, m, k in (('fb', 'fused', 'behavior'), ('eb', 'encounter_only', 'behavior'), ('fe', 'fused', 'encounter'), ('ee', 'encounter_only', 'encounter')))}
  FROM ({_FOLDS}) GROUP BY fold, budget)"""
_as("fusion_folds", lambda s, d: ranking.fusion_folds(folds(s, d)), sql(_PASSES))
_as("fusion_gate", lambda s, d: ranking.fusion_gate(folds(s, d)), sql(f"""
SELECT *, CAST(sum(passed) OVER () >= 2 AS INT) AS gate_passed FROM (SELECT *, CAST(good_folds * 2 > folds AS INT) AS passed FROM (SELECT budget, count(*) AS folds, CAST(sum(passes) AS BIGINT) AS good_folds FROM ({_PASSES}) GROUP BY budget))"""))
_as("geojson_points", lambda s, d: publish.point_layer(points(s, d), "anomaly_score", ["cell_id", "anomaly_score", "reasons", "evidence_tier"]), None)
_as("geojson_cells", lambda s, d: publish.cell_layer(raster.density(features(s, d), BAY), BAY, ["point_count", "mean_sog"]), None)
_as("geojson_tracks", lambda s, d: publish.line_layer(features(s, d), ["date", "track_id"]), None)
_as("sanitised", lambda s, d: publish.sanitise(points(s, d)).select("date", "cell_id", "longitude", "latitude", "anomaly_score"), sql("SELECT date, cell_id, floor(longitude * 10000 + 0.5) / 10000 AS longitude, floor(latitude * 10000 + 0.5) / 10000 AS latitude, anomaly_score FROM points"))

@shared
def judged_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and controls with what followed."""
    return future.backtest(anchors(spark, sf_dir).withColumn("t0", F.col("g")), features(spark, sf_dir), RELAXED)


def stage_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r = records(spark, sf_dir)
    return {
        "clean_points": cleaned(spark, sf_dir), "anomaly_candidate_points": points(spark, sf_dir), "encounter_candidate_records": r.where("is_candidate = 1"), "encounter_audit_episodes": episodes(spark, sf_dir),
        "backtest_supported_episodes": backtest(spark, sf_dir, RELAXED).where("supported = 1"), "fused_hotspot_cells": hot(spark, sf_dir).where("is_hotspot = 1"), "representative_case_tracks": behavior.case_tracks(points(spark, sf_dir)),
    }


def encounter_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.encounter_cards(backtest(spark, sf_dir, RELAXED), records(spark, sf_dir))


_values = lambda rows, name: f"(VALUES {', '.join('(' + ', '.join(oracle.D(x) for x in r) + ')' for r in rows)}) {name}"
_as("score_levels", lambda s, d: assessment.score_levels(scored(s, d)), sql(f"SELECT level, count(*) AS scored_rows, count(*) FILTER (WHERE anomaly_score >= level) AS candidates, round(count(*) FILTER (WHERE anomaly_score >= level) * {oracle.D(100)} / count(*), 6) AS rate_percent FROM scored CROSS JOIN {_values([(x,) for x in assessment.LEVELS], 'l(level)')} GROUP BY level"))
_as("nested_encounters", lambda s, d: assessment.nested_encounters(records(s, d)), sql(f"SELECT dcpa_limit_nm, tcpa_limit_min, count(g) AS candidates FROM {_values(assessment.NESTED, 'l(dcpa_limit_nm, tcpa_limit_min)')} LEFT JOIN (SELECT * FROM opps WHERE is_candidate = 1) ON dcpa_nm <= dcpa_limit_nm AND tcpa_min <= tcpa_limit_min GROUP BY 1, 2"))
_as("cell_sizes", lambda s, d: assessment.cell_sizes(features(s, d), BAY, GATES), sql(" UNION ALL ".join(f"""
SELECT {oracle.D(z)} AS cell_deg, n.normal_cells, n.high_cells, h.scored_rows, h.candidates, round(h.candidates * {oracle.D(100)} / h.scored_rows, 6) AS rate_percent
FROM (SELECT count(*) AS scored_rows, count(*) FILTER (WHERE anomaly_score >= 0.35) AS candidates FROM {t}scored) h, (SELECT CAST(sum(is_normal) AS BIGINT) AS normal_cells, CAST(sum(is_high_confidence) AS BIGINT) AS high_cells FROM {t}patterns) n"""
    for z, t in ((0.003, "size3_"), (0.005, ""), (0.01, "size10_")))))
_as("held_out_days", lambda s, d: assessment.held_out_days(features(s, d), fold_patterns(s, d), BAY), sql(f"""
SELECT h.fold AS test_date, p.normal_cells, p.high_cells, h.scored_rows, h.candidates, round(h.candidates * {oracle.D(100)} / h.scored_rows, 6) AS rate_percent
FROM (SELECT fold, count(*) AS scored_rows, count(*) FILTER (WHERE anomaly_score >= 0.35) AS candidates FROM (SELECT * FROM fold_scored) WHERE date = fold GROUP BY fold) h
JOIN (SELECT fold, CAST(sum(is_normal) AS BIGINT) AS normal_cells, CAST(sum(is_high_confidence) AS BIGINT) AS high_cells FROM fold_patterns GROUP BY fold) p USING (fold)"""))
_as("densest_bins", lambda s, d: assessment.densest_bins(states(s, d), 2.0), sql("SELECT t.g, t.vessels, coalesce(p.n, 0) AS indexed, coalesce(p.n, 0) AS brute, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra FROM (SELECT g, count(*) AS vessels FROM states GROUP BY g ORDER BY vessels DESC, g DESC LIMIT 12) t LEFT JOIN (SELECT g, count(*) AS n FROM pairs GROUP BY g) p USING (g)"))
_moved = lambda s: f"round(CASE WHEN t = t_{s} THEN lon_{s} ELSE lon_{s} + degrees(sog_{s} * sin(radians(course_{s})) * ((t - t_{s}) / {oracle.D(3600)}) / ({oracle.D(oracle.R)} * cos(radians(lat_{s})))) END, 6) AS lon_{s}, round(CASE WHEN t = t_{s} THEN lat_{s} ELSE lat_{s} + degrees(sog_{s} * cos(radians(course_{s})) * ((t - t_{s}) / {oracle.D(3600)}) / {oracle.D(oracle.R)}) END, 6) AS lat_{s}"
_as(
    "synchronised", lambda s, d: assessment.synchronised(encounters.pairs_within(states(s, d), 2.0), Encounter(max_age_s=30)).withColumns({f"{c}_{v}": F.round(f"{c}_{v}", 6) for c in ("lon", "lat") for v in "ab"}),
    sql(f"SELECT g, mmsi_a, mmsi_b, t, state_skew_s, {_moved('a')}, {_moved('b')} FROM (SELECT *, greatest(t_a, t_b) AS t, abs(t_a - t_b) AS state_skew_s FROM pairs) WHERE state_skew_s <= 30"), "g", "mmsi_a", "mmsi_b", "t", "state_skew_s", "lon_a", "lat_a", "lon_b", "lat_b",
)
_as("match_differences", lambda s, d: assessment.differences(matched(s, d)), None)
_bins = lambda c, edges, labels: f"CASE WHEN {c} IS NULL THEN '{assessment.MISSING}' " + " ".join(f"WHEN {c} < {oracle.D(e)} THEN '{x}'" for e, x in zip(edges, labels, strict=False)) + f" ELSE '{labels[-1]}' END"
_CALIBRATED = " UNION ALL ".join(f"SELECT '{c}' AS variable, {_bins(c, *spec)} AS bin, observable, actual_min_nm FROM carded" for c, spec in assessment.CALIBRATION.items())
_as("calibration_candidates", lambda s, d: assessment.calibration(backtest(s, d, RELAXED).withColumn("anchor_type", F.lit("candidate"))), sql(f"SELECT *, round(CAST(within_half_nm AS DOUBLE) / nullif(observable, 0), 6) AS half_rate, round(CAST(within_one_nm AS DOUBLE) / nullif(observable, 0), 6) AS one_rate FROM (SELECT variable, 'candidate' AS anchor_type, bin, count(*) AS anchors, count(*) FILTER (WHERE observable = 1) AS observable, count(*) FILTER (WHERE observable = 1 AND actual_min_nm <= 0.5) AS within_half_nm, count(*) FILTER (WHERE observable = 1 AND actual_min_nm <= 1) AS within_one_nm FROM ({_CALIBRATED}) GROUP BY variable, bin)"))
_ALL_CALIBRATED = " UNION ALL ".join(f"SELECT '{c}' AS variable, anchor_type, {_bins(c, *spec)} AS bin, observable, actual_min_nm FROM anchors" for c, spec in assessment.CALIBRATION.items())
_as("calibration", lambda s, d: assessment.calibration(judged_anchors(s, d)), sql(f"""
SELECT *, round(CAST(within_half_nm AS DOUBLE) / nullif(observable, 0), 6) AS half_rate, round(CAST(within_one_nm AS DOUBLE) / nullif(observable, 0), 6) AS one_rate FROM (
  SELECT variable, anchor_type, bin, count(*) AS anchors, count(*) FILTER (WHERE observable = 1) AS observable, count(*) FILTER (WHERE observable = 1 AND actual_min_nm <= 0.5) AS within_half_nm,
    count(*) FILTER (WHERE observable = 1 AND actual_min_nm <= 1) AS within_one_nm FROM ({_ALL_CALIBRATED}) GROUP BY variable, anchor_type, bin)"""))
_as("composition", lambda s, d: assessment.composition(judged_anchors(s, d)), sql(" UNION ALL ".join(f"""
SELECT {oracle.D(x)} AS threshold_nm, count(*) AS anchors, count(*) FILTER (WHERE anchor_type = 'candidate') AS candidates, round(CAST(count(*) FILTER (WHERE anchor_type = 'candidate') AS DOUBLE) / nullif(count(*), 0), 6) AS candidate_share
FROM anchors WHERE observable = 1 AND actual_min_nm <= {x}""" for x in (0.5, 1.0))))
_as("outcome_intervals", lambda s, d: assessment.intervals(matched(s, d), judged_anchors(s, d)), None)
_MEASURES = ["clean_rows", "unique_mmsi", "tracks", "long_tracks", "long_rows", "grid_cells", "max_cell_count"]
_as("daily_summary", lambda s, d: assessment.daily(features(s, d), BAY), sql("SELECT * FROM day_counts"))
_as("daily_descriptors", lambda s, d: assessment.descriptors(assessment.daily(features(s, d), BAY)), sql(" UNION ALL ".join(f"SELECT '{m}' AS measure, count({m}) AS days, CAST(min({m}) AS DOUBLE) AS least, round(avg({m}), 6) AS mean, CAST(max({m}) AS DOUBLE) AS most, round(stddev_pop({m}) / nullif(avg({m}), 0), 6) AS cv, round(CAST(sum({m}) AS DOUBLE), 6) AS total FROM day_counts" for m in _MEASURES)))
_share = lambda o: f"round(len(list_intersect(c, {o})) / CAST(len(list_distinct(list_concat(c, {o}))) AS DOUBLE), 6)"
_as("day_overlap", lambda s, d: assessment.day_overlap(raster.density(features(s, d), BAY, "date")), sql(f"SELECT date, CAST(len(c) AS INT) AS cells, {_share('f')} AS overlap_first, CASE WHEN p IS NOT NULL THEN {_share('p')} END AS overlap_previous FROM (SELECT *, first(c) OVER (ORDER BY date) AS f, lag(c) OVER (ORDER BY date) AS p FROM (SELECT date, list(cell_id) AS c FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY point_count DESC, cell_id) AS r FROM daily_density) WHERE r <= 50 GROUP BY date))"))
_STAGES = {"clean_points": "cleaned", "anomaly_candidate_points": "points", "encounter_candidate_records": "opps WHERE is_candidate = 1", "encounter_audit_episodes": "episodes", "backtest_supported_episodes": "relaxed WHERE supported = 1", "fused_hotspot_cells": "hot WHERE is_hotspot = 1", "representative_case_tracks": "(SELECT DISTINCT date, mmsi, track_id FROM points LIMIT 7)"}
_as("workload_stages", lambda s, d: assessment.stages(**stage_tables(s, d)), sql(f"SELECT stage_no, stage, n, round(n * {oracle.D(100)} / nullif(first(n) OVER (ORDER BY stage_no), 0), 6) AS share_percent, round(CAST(first(n) OVER (ORDER BY stage_no) AS DOUBLE) / nullif(n, 0), 3) AS ratio FROM ({' UNION ALL '.join(f'SELECT {i} AS stage_no, {chr(39)}{k}{chr(39)} AS stage, count(*) AS n FROM {v}' for i, (k, v) in enumerate(_STAGES.items()))})"))
_as("fingerprint", lambda s, d: assessment.fingerprint(raster.density(features(s, d), BAY), ["cell_id", "point_count", "moving_count"]), sql("SELECT n AS n_rows, sha256(CAST(n AS VARCHAR) || '|' || a || '|' || b) AS sha256 FROM (SELECT count(*) AS n, CAST(coalesce(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)), 0) AS VARCHAR) AS a, CAST(coalesce(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)), 0) AS VARCHAR) AS b FROM (SELECT sha256(cell_id || '|' || CAST(point_count AS VARCHAR) || '|' || CAST(moving_count AS VARCHAR)) AS h FROM density))"))
_as("case_selection", lambda s, d: cards.select_cases(points(s, d)), None)
_as("hotspot_cards", lambda s, d: hot_cards(s, d), sql(f"""
SELECT format('hotspot_card_{{:03d}}', h.rank) AS card_id, CAST(h.rank AS INT) AS rank, h.cell_id, h.risk_score, t.hotspot_type, t.dominant_evidence, t.stability_class,
  {', '.join(f'CAST(h.{c} AS BIGINT) AS {c}' for c in ('point_count', 'moving_count', 'anomaly_count', 'low_support_count', 'encounter_count'))},
  CAST(coalesce(b.n, 0) AS BIGINT) AS episodes, CAST(coalesce(b.s, 0) AS BIGINT) AS supported_episodes, t.anomaly_share, t.encounter_share, t.density_days, t.fused_days
FROM (SELECT *, row_number() OVER (ORDER BY risk_score DESC, cell_id) AS rank FROM hot WHERE is_hotspot = 1) h JOIN ({_TYPED}) t USING (cell_id)
LEFT JOIN (SELECT cell_id, count(*) AS n, sum(supported) AS s FROM relaxed GROUP BY cell_id) b USING (cell_id)"""))
_at = lambda v: f"round({oracle.plane_x(f'o.lon_{v}', 'c.lon_mid', 'c.lat_mid')}, 4) AS x_{v}_nm, round({oracle.plane_y(f'o.lat_{v}', 'c.lat_mid')}, 4) AS y_{v}_nm"
_CARDS = f"SELECT 'enc-' || lpad(CAST(c.rank AS VARCHAR), 3, '0') AS case_id, CAST(c.rank AS INT) AS rank, CASE WHEN c.observable = 0 THEN '{cards.STATUS[0]}' WHEN c.supported = 1 THEN '{cards.STATUS[1]}' WHEN c.near_supported = 1 THEN '{cards.STATUS[2]}' ELSE '{cards.STATUS[3]}' END AS support_status, c.current_distance_nm, c.dcpa_nm, c.tcpa_min, {_at('a')}, {_at('b')}, c.actual_min_nm, c.coverage_s, 900 AS window_s, round(c.coverage_s / {oracle.D(900)}, 6) AS coverage_fraction, c.record_count FROM carded c JOIN opps o ON o.mmsi_a = c.mmsi_a AND o.mmsi_b = c.mmsi_b AND o.g = c.t0 WHERE c.rank <= 12"
_as("encounter_cards", encounter_cards, sql(_CARDS))
_as("card_problems", lambda s, d: cards.card_problems(encounter_cards(s, d)).select("case_id", "rank"), sql(f"SELECT case_id, rank FROM ({_CARDS}) WHERE abs(sqrt((x_b_nm - x_a_nm) * (x_b_nm - x_a_nm) + (y_b_nm - y_a_nm) * (y_b_nm - y_a_nm)) - current_distance_nm) > 0.05 OR (tcpa_min > 0 AND dcpa_nm > current_distance_nm + 0.05) OR coverage_s > window_s"))
_N = "(SELECT count(*) FROM {})"
_CHECKS = {
    "episodes_backtested": (_N.format("episodes"), _N.format("relaxed")), "episode_records": ("(SELECT coalesce(sum(record_count), 0) FROM episodes)", _N.format("opps WHERE is_candidate = 1")),
    "anomalies_in_cells": (_N.format("points WHERE cell_id IS NOT NULL"), "(SELECT coalesce(sum(anomaly_count), 0) FROM hot)"), "encounters_in_cells": (_N.format("opps WHERE is_candidate = 1 AND cell_id IS NOT NULL"), "(SELECT coalesce(sum(encounter_count), 0) FROM hot)"),
    "supported_are_observable": (_N.format("relaxed WHERE supported = 1"), _N.format("relaxed WHERE supported = 1 AND observable = 1")),
}
_as("bundle_checks", lambda s, d: cards.bundle_checks(points(s, d), hot(s, d), episodes(s, d), backtest(s, d, RELAXED), records(s, d)), sql('SELECT "check", a, b, a = b AS ok FROM (' + " UNION ALL ".join(f'SELECT \'{k}\' AS "check", CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b' for k, (a, b) in _CHECKS.items()) + ")"))

_as("encounter_paths", lambda s, d: report.relative_paths(written(cards.best_episodes(backtest(s, d, RELAXED))), features(s, d), RELAXED), sql(f"""
SELECT 'enc-' || lpad(CAST(rank AS VARCHAR), 3, '0') AS case_id, b - t0 AS start_t_s, z - t0 AS end_t_s, upper(side) AS label, CAST(round(tau - t0) AS BIGINT) AS t_s,
  round({oracle.plane_x('x', 'lon_mid', 'lat_mid')}, 2) AS x_nm, round({oracle.plane_y('y', 'lat_mid')}, 2) AS y_nm FROM path_spots"""))


def hot_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.hotspot_cards(hot(spark, sf_dir), typed(spark, sf_dir), backtest(spark, sf_dir, RELAXED))


_as("hotspot_card_cases", lambda s, d: report.card_cases(hot_cards(s, d), cards.select_cases(points(s, d)), points(s, d)), None)


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the web page of a run shows, as rows of section, name and value."""
    days, seen, types = assessment.daily(features(spark, sf_dir), BAY), points(spark, sf_dir), written(typed(spark, sf_dir))
    near = assessment.day_overlap(raster.density(features(spark, sf_dir), BAY, "date"))
    tier = lambda t: F.count_if(F.col("evidence_tier") == t)
    out = report.figures(
        dataset=days.agg(F.count("*").alias("days"), *[F.sum(c).alias(c) for c in ("clean_rows", "tracks", "long_tracks", "long_rows")], F.avg("clean_rows").alias("mean_daily_rows")),
        traffic_patterns=patterns(spark, sf_dir).agg(F.sum("is_normal").alias("normal_cells"), F.sum("is_high_confidence").alias("high_cells")),
        anomalies=seen.agg(F.count("*").alias("candidates"), tier("corroborated_candidate").alias("corroborated"), tier("low_support_only").alias("low_support")),
        encounters=encounters.summary(records(spark, sf_dir)),
        backtest=future.backtest_summary(backtest(spark, sf_dir, RELAXED)).select("episodes", "observable", "supported", "near_supported", "observable_rate", "support_rate", "near_rate"),
        hotspots=hot(spark, sf_dir).agg(F.sum("is_hotspot").alias("hotspots"), F.sum("eligible").alias("eligible")),
        cards=hot_cards(spark, sf_dir).agg(F.count("*").alias("cards"), F.coalesce(F.sum("episodes"), F.lit(0)).alias("episodes"), F.coalesce(F.sum("supported_episodes"), F.lit(0)).alias("supported")),
        stability=near.withColumn("f", F.when(F.col("date") > F.min("date").over(Window.partitionBy(F.lit(1))), F.col("overlap_first"))).agg(F.avg("overlap_previous").alias("mean_previous"), F.min("overlap_previous").alias("least_previous"), F.max("overlap_previous").alias("most_previous"), F.avg("f").alias("mean_first")),
    )
    reasons = behavior.counters(seen).where("kind = 'reason'").select(F.lit("reasons").alias("section"), "name", F.col("n").cast("double").alias("value"))
    for more in (reasons, *[report.counted(types, c) for c in ("hotspot_type", "dominant_evidence", "stability_class")]):
        out = out.unionByName(more)
    return out


def _figures(section: str, names: str, table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{n}' AS name, round(CAST({n} AS DOUBLE), 6) AS value FROM ({table}) WHERE {n} IS NOT NULL" for n in names.split())


_OVERLAPS = f"SELECT date, {_share('f')} AS overlap_first, CASE WHEN p IS NOT NULL THEN {_share('p')} END AS overlap_previous FROM (SELECT *, first(c) OVER (ORDER BY date) AS f, lag(c) OVER (ORDER BY date) AS p FROM (SELECT date, list(cell_id) AS c FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY point_count DESC, cell_id) AS r FROM daily_density) WHERE r <= 50 GROUP BY date))"
_as("web_summary", summary, sql(" UNION ALL ".join([
    _figures("dataset", "days clean_rows tracks long_tracks long_rows mean_daily_rows", "SELECT count(*) AS days, sum(clean_rows) AS clean_rows, sum(tracks) AS tracks, sum(long_tracks) AS long_tracks, sum(long_rows) AS long_rows, avg(clean_rows) AS mean_daily_rows FROM day_counts"),
    _figures("traffic_patterns", "normal_cells high_cells", "SELECT sum(is_normal) AS normal_cells, sum(is_high_confidence) AS high_cells FROM patterns"),
    _figures("anomalies", "candidates corroborated low_support", "SELECT count(*) AS candidates, count(*) FILTER (WHERE evidence_tier = 'corroborated_candidate') AS corroborated, count(*) FILTER (WHERE evidence_tier = 'low_support_only') AS low_support FROM points"),
    _figures("encounters", "candidates pairs pair_days episodes", "SELECT count(*) AS candidates, count(DISTINCT mmsi_a || '|' || mmsi_b) AS pairs, count(DISTINCT date || mmsi_a || mmsi_b) AS pair_days, count(DISTINCT date || mmsi_a || mmsi_b || island) AS episodes FROM islands"),
    _figures("backtest", "episodes observable supported near_supported observable_rate support_rate near_rate", f"SELECT *, CAST(observable AS DOUBLE) / episodes AS observable_rate, CAST(supported AS DOUBLE) / nullif(observable, 0) AS support_rate, CAST(near_supported AS DOUBLE) / nullif(observable, 0) AS near_rate FROM (SELECT count(*) AS episodes, {_SUMS} FROM relaxed)"),
    _figures("hotspots", "hotspots eligible", "SELECT sum(is_hotspot) AS hotspots, sum(eligible) AS eligible FROM hot"),
    _figures("cards", "cards episodes supported", "SELECT count(DISTINCT h.cell_id) AS cards, count(r.t0) AS episodes, coalesce(sum(r.supported), 0) AS supported FROM (SELECT * FROM hot WHERE is_hotspot = 1) h LEFT JOIN (SELECT * FROM relaxed) r USING (cell_id)"),
    _figures("stability", "mean_previous least_previous most_previous mean_first", f"SELECT avg(overlap_previous) AS mean_previous, min(overlap_previous) AS least_previous, max(overlap_previous) AS most_previous, avg(f) AS mean_first FROM (SELECT *, CASE WHEN date > min(date) OVER () THEN overlap_first END AS f FROM ({_OVERLAPS}))"),
    "SELECT 'reasons', name, CAST(count(*) AS DOUBLE) FROM (SELECT unnest(string_split(reasons, ';')) AS name FROM points) GROUP BY name",
    *[f"SELECT '{c}', {c}, CAST(count(*) AS DOUBLE) FROM ({_TYPED}) GROUP BY {c}" for c in ("hotspot_type", "dominant_evidence", "stability_class")],
])))


# What a relational engine offers beyond the screening chain, on the order tables.
query("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")(
    lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))
)
query("segment_rollup", "SELECT r_name, n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")(
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").join(s.read.parquet(f"{d}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).join(s.read.parquet(f"{d}/region.parquet"), F.col("n_regionkey") == F.col("r_regionkey")).rollup("r_name", "n_name").agg(F.count("*").alias("customers"))
)
query("quiet_customers", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").join(s.read.parquet(f"{d}/orders.parquet"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
)
