"""Evidence of cells fused into rankings, hotspots, their stability and their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Hotspot

#: Methods and how they score a cell.
METHODS = {"density_only": (1.0, 0.0, 0.0), "behavior_only": (0.0, 1.0, 0.0), "encounter_only": (0.0, 0.0, 1.0), "fused": (0.0, 1.0, 0.75)}
STABILITY = {"density_only": (1.0, 0.0, 0.0), "anomaly_only": (0.0, 1.0, 0.0), "encounter_only": (0.0, 0.0, 1.0), "fused_risk": (0.0, 1.0, 0.75)}
SCREENING = {"density_only": (1.0, 0.0, 0.0), "anomaly_only": (0.0, 1.0, 0.0), "encounter_only": (0.0, 0.0, 1.0), "fused_w0.50": (0.0, 1.0, 0.5), "fused_w0.75": (0.0, 1.0, 0.75), "fused_w1.00": (0.0, 1.0, 1.0)}

#: Kinds of targets.
KINDS = ("behavior", "encounter")

#: Names of classes and what is to be reviewed.
EVIDENCE = ("anomaly-dominated fused evidence", "encounter-dominated fused evidence", "balanced anomaly-encounter evidence", "behavior-component-only candidate evidence", "encounter-only candidate evidence", "exposure-only context")
STEADY = ("stable exposure with persistent candidate evidence", "stable traffic-exposure hotspot", "persistent candidate-evidence hotspot", "event-sensitive candidate hotspot", "high-exposure context cell", "intermittent evidence cell")
FOCUS = (
    "Compare stable traffic exposure with candidate evidence; density alone is not a safety finding.",
    "Review close-quarters candidate episodes and local crossing or meeting context.",
    ("Review behavioral deviation evidence, especially ", "the dominant anomaly reason", "."),
    "Review combined behavioral and encounter evidence before any operational interpretation.",
    ("Review ", " evidence as a candidate screening cue."),
    "Use as contextual screening evidence for human audit.",
)
TYPES = ("non-hotspot high-exposure context", "non-hotspot candidate context", "stable-exposure review hotspot", "persistent candidate-evidence hotspot", "event-sensitive review hotspot", "encounter-dominated review hotspot", "anomaly-dominated review hotspot", "fused-evidence review hotspot")


def evidence(points: DataFrame, records: DataFrame, exposure: DataFrame, density: DataFrame, h: Hotspot = Hotspot(), *keys: str) -> DataFrame:
    """Anomalies, encounters, opportunities and traffic of each cell (of each key).

    The tables are stacked and summed once, which takes one exchange where three full outer joins would take several.
    """
    k = [*keys, "cell_id"]
    low = F.col("evidence_tier") == "low_support_only"
    w = F.when(low, h.low_support_weight).otherwise(1.0)
    names = ["anomaly_count", "low_support_count", "weighted_count", "weighted_score", "encounter_count", "encounter_score", "opportunities", "point_count", "moving_count", "is_evidence"]

    def rows(df: DataFrame, evidence: int, **values: Column) -> DataFrame:
        return df.select(*k, *[(values[n] if n in values else F.lit(evidence if n == "is_evidence" else 0)).cast("double").alias(n) for n in names])

    one = F.lit(1)
    stacked = (
        rows(points, 1, anomaly_count=one, low_support_count=low.cast("int"), weighted_count=w, weighted_score=w * F.col("anomaly_score"))
        .unionByName(rows(records.where("is_candidate = 1 AND cell_id IS NOT NULL"), 1, encounter_count=one, encounter_score=F.col("encounter_score")))
        .unionByName(rows(exposure, 1, opportunities=F.col("pair_opportunity_count")))
        .unionByName(rows(density, 0, point_count=F.col("point_count"), moving_count=F.col("moving_count")))
    )
    return stacked.groupBy(*k).agg(*[F.sum(n).alias(n) for n in names])


def with_components(e: DataFrame) -> DataFrame:
    """Adds ln(1 + n) * mean score * sqrt(rate) of both kinds of evidence."""
    c = F.col

    def part(n: str, score: str, of: str) -> Column:
        rate = F.try_divide(c(n), c(of))
        return F.when((c(n) > 0) & (rate > 0), F.log1p(c(n)) * F.try_divide(c(score), c(n)) * F.sqrt(rate)).otherwise(0.0)

    return e.withColumns({"anomaly_component": F.round(F.coalesce(part("weighted_count", "weighted_score", "moving_count"), F.lit(0.0)), 8), "encounter_component": F.round(F.coalesce(part("encounter_count", "encounter_score", "opportunities"), F.lit(0.0)), 8)})


def hotspots(e: DataFrame, h: Hotspot = Hotspot()) -> DataFrame:
    """Cells with evidence, scored relative to the best eligible one; the best share of the eligible ones are hotspots. A grid bounds the cells."""
    c = F.col
    df = with_components(e.where("is_evidence > 0"))
    ok = (c("point_count") >= h.min_points) & (c("moving_count") >= h.min_moving) & ((c("anomaly_count") >= h.min_anomalies) | (c("encounter_count") >= h.min_encounters))
    df = df.withColumns({"eligible": F.coalesce(ok, F.lit(False)).cast("int"), "_raw": c("anomaly_component") + h.encounter_weight * c("encounter_component")})
    top = df.agg(F.coalesce(F.max(F.when(c("eligible") == 1, c("_raw"))), F.max("_raw")).alias("_top"), F.sum("eligible").alias("_n"))
    df = df.crossJoin(F.broadcast(top)).withColumn("risk_score", F.coalesce(F.round(F.try_divide(c("_raw"), c("_top")), 6), F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("eligible").orderBy(F.desc("risk_score"), "cell_id"))
    hot = (c("eligible") == 1) & (rank <= F.greatest(F.lit(1), F.floor(c("_n") * h.top_share)))
    return df.withColumn("is_hotspot", hot.cast("int")).select("cell_id", *[c(n).cast("bigint").alias(n) for n in ("anomaly_count", "low_support_count", "encounter_count", "opportunities", "point_count", "moving_count")], "anomaly_component", "encounter_component", "eligible", "risk_score", "is_hotspot")


def _scores(df: DataFrame, methods: dict[str, tuple[float, float, float]]) -> DataFrame:
    """One row for each cell and method."""
    each = F.array(*[F.struct(F.lit(m).alias("method"), F.round(a * F.col("point_count") + b * F.col("anomaly_component") + d * F.col("encounter_component"), 8).alias("score")) for m, (a, b, d) in methods.items()])
    return df.select("*", F.explode(each).alias("_s")).select("*", "_s.*").drop("_s")


def stability(daily: DataFrame, h: Hotspot = Hotspot(min_points=20, min_moving=5, min_anomalies=3, min_encounters=3), k: int = 25) -> DataFrame:
    """Best cells of each day and variant, and how far they agree with the day before and the first day."""
    c = F.col
    base, a, b = c("point_count") >= h.min_points, c("anomaly_count") >= h.min_anomalies, c("encounter_count") >= h.min_encounters
    moving = base & (c("moving_count") >= h.min_moving)
    rows = _scores(with_components(daily), {**STABILITY, "fused_risk": (0, 1.0, h.encounter_weight)})
    fit = F.when(c("method") == "density_only", base).when(c("method") == "anomaly_only", moving & a).when(c("method") == "encounter_only", moving & b).otherwise(moving & (a | b))
    ranked = rows.where(fit).withColumn("_r", F.row_number().over(Window.partitionBy("date", "method").orderBy(F.desc("score"), "cell_id")))
    chosen = ranked.where(c("_r") <= k).groupBy("date", "method").agg(F.collect_set("cell_id").alias("cells"), F.array_sort(F.collect_list(F.when(c("_r") <= 10, c("cell_id")))).alias("top_cells"))
    names = F.explode(F.array(*map(F.lit, STABILITY))).alias("method")
    every = daily.select("date").distinct().select("date", names).join(chosen, ["date", "method"], "left").withColumn("cells", F.coalesce("cells", F.array().cast("array<string>")))
    w = Window.partitionBy("method").orderBy("date")
    overlap = lambda other: F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("cells", other)), F.size(F.array_union("cells", other))), F.lit(0.0)), 6)
    df = every.withColumns({"_prev": F.lag("cells").over(w), "_first": F.first("cells").over(w)})
    return df.select("date", "method", F.size("cells").alias("selected_cells"), overlap(c("_first")).alias("overlap_first"), F.when(c("_prev").isNotNull(), overlap(c("_prev"))).alias("overlap_previous"), "top_cells")


def main_reasons(points: DataFrame) -> DataFrame:
    """Of each cell the reason that most of its candidates have; of equally common ones the one that was seen first."""
    each = points.select("cell_id", "ordinal", F.posexplode(F.split("reasons", ";")).alias("at", "reason")).where("reason <> ''")
    counted = each.groupBy("cell_id", "reason").agg(F.count("*").alias("_n"), F.min(F.struct("ordinal", "at")).alias("_first"))
    return counted.groupBy("cell_id").agg(F.min_by("reason", F.struct(-F.col("_n"), "_first")).alias("dominant_reason"))


def typology(hot: DataFrame, stable: DataFrame, reasons: DataFrame, days: int, weight: float = 0.75) -> DataFrame:
    """Which evidence carries a cell, how steady it is, so what kind of cell it is, and what a reviewer should look at. ``reasons``: of ``main_reasons``."""
    c = F.col
    hot = hot.join(reasons.select("cell_id", "dominant_reason"), "cell_id", "left")
    top = stable.select("method", F.explode("top_cells").alias("cell_id")).groupBy("cell_id").agg(F.count_if(c("method") == "density_only").alias("density_days"), F.count_if(c("method") == "fused_risk").alias("fused_days"))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("point_count"), "cell_id")) - 1  # the cells of a grid
    df = hot.join(top, "cell_id", "left").withColumns({"density_days": F.coalesce("density_days", F.lit(0)), "fused_days": F.coalesce("fused_days", F.lit(0)), "density_percentile": F.round(1 - place / F.greatest(F.lit(1), n - 1), 6)})
    a, b = c("anomaly_component"), c("encounter_component") * weight
    df = df.withColumns({"anomaly_share": F.round(F.coalesce(F.try_divide(a, a + b), F.lit(0.0)), 6), "encounter_share": F.round(F.coalesce(F.try_divide(b, a + b), F.lit(0.0)), 6)})
    both = (c("anomaly_count") > 0) & (c("encounter_count") > 0)
    kind = (
        F.when(both & (c("anomaly_share") >= 0.65), EVIDENCE[0]).when(both & (c("encounter_share") >= 0.65), EVIDENCE[1]).when(both, EVIDENCE[2])
        .when(c("anomaly_count") > 0, EVIDENCE[3]).when(c("encounter_count") > 0, EVIDENCE[4]).otherwise(EVIDENCE[5])
    )
    need = max(3, round(days * 0.5))
    long_dense, long_fused, hot_cell = c("density_days") >= need, c("fused_days") >= need, c("is_hotspot") == 1
    steady = (
        F.when(long_dense & long_fused, STEADY[0]).when(long_dense, STEADY[1]).when(long_fused, STEADY[2])
        .when(hot_cell & ((c("fused_days") > 0) | (c("density_percentile") < 0.75)), STEADY[3]).when(c("density_percentile") >= 0.9, STEADY[4]).otherwise(STEADY[5])
    )
    s, d = c("stability_class"), c("dominant_evidence")
    cell_type = (
        F.when(~hot_cell & (c("density_percentile") >= 0.9), TYPES[0]).when(~hot_cell, TYPES[1]).when(s == STEADY[1], TYPES[2]).when(s.isin(STEADY[0], STEADY[2]), TYPES[3])
        .when(s == STEADY[3], TYPES[4]).when(d == EVIDENCE[1], TYPES[5]).when(d == EVIDENCE[0], TYPES[6]).otherwise(TYPES[7])
    )
    why = F.replace(F.coalesce("dominant_reason", F.lit("")), F.lit("_"), F.lit(" "))
    especially = F.concat(F.lit(FOCUS[2][0]), F.when(why == "", FOCUS[2][1]).otherwise(why), F.lit(FOCUS[2][2]))
    focus = (
        F.when(s == STEADY[1], FOCUS[0]).when(d == EVIDENCE[1], FOCUS[1]).when(d == EVIDENCE[0], especially).when(d == EVIDENCE[2], FOCUS[3])
        .when(why != "", F.concat(F.lit(FOCUS[4][0]), why, F.lit(FOCUS[4][1]))).otherwise(FOCUS[5])
    )
    names = ["cell_id", "is_hotspot", "density_percentile", "anomaly_share", "encounter_share", "density_days", "fused_days", "dominant_reason"]
    named = df.withColumns({"dominant_evidence": kind, "stability_class": steady}).withColumns({"hotspot_type": cell_type, "review_focus": focus})
    return named.select(*names, "dominant_evidence", "stability_class", "hotspot_type", "review_focus")


def _best(cells: DataFrame, methods: dict[str, tuple[float, float, float]], budgets: tuple[float, ...], up: bool, *keys: str) -> DataFrame:
    """The cells that each method chooses within each budget; at least one. The cells of a grid bound the ranking of a method."""
    by = [*keys, "method"]
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "cell_id"))
    ranked = _scores(cells, methods).select(*by, "cell_id", order.alias("_r"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    most = F.ceil(F.col("_n") * F.col("budget")) if up else F.floor(F.col("_n") * F.col("budget"))
    return ranked.select("*", F.explode(F.array(*map(F.lit, budgets))).alias("budget")).where(F.col("_r") <= F.greatest(F.lit(1), most)).select(*by, "budget", "cell_id")


def rank_evaluation(cells: DataFrame, targets: DataFrame, methods: dict[str, tuple[float, float, float]] = METHODS, budgets: tuple[float, ...] = (0.05, 0.10, 0.20), up: bool = True, *keys: str) -> DataFrame:
    """How many targets each method's best cells hold, by budget and kind of target. Targets outside the ranked cells stay in the denominator; without targets the rate is null.

    ``cells``: cell_id and components; ``targets``: kind (of ``KINDS``) and cell_id; ``up``: budgets are rounded up.
    """
    by = [*keys, "method"]
    counted = targets.groupBy(*keys, "kind", "cell_id").agg(F.count("*").alias("_t"))
    total = counted.groupBy(*keys, "kind").agg(F.sum("_t").alias("targets"))
    spread = _best(cells, methods, budgets, up, *keys).select("*", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
    held = spread.join(counted, [*keys, "kind", "cell_id"], "left").groupBy(*by, "budget", "kind").agg(F.count("*").alias("selected_cells"), F.coalesce(F.sum("_t"), F.lit(0)).alias("captured"))
    rate = F.round(F.try_divide(F.col("captured").cast("double"), F.col("targets")), 6)
    return held.join(F.broadcast(total), [*keys, "kind"], "left").select(*by, "budget", "kind", "selected_cells", "captured", F.coalesce("targets", F.lit(0)).alias("targets"), rate.alias("capture_rate"))


def screening(cells: DataFrame, episodes: DataFrame, budgets: tuple[float, ...] = (0.05, 0.10, 0.20)) -> DataFrame:
    """What the episodes in each screening method's best cells came to, against those of all ranked cells. Episodes elsewhere are left out.

    ``episodes``: cell_id, observable, supported.
    """
    inside = episodes.where("observable = 1").join(cells.select("cell_id"), "cell_id", "left_semi")
    by_cell = inside.groupBy("cell_id").agg(F.count("*").alias("_n"), F.sum("supported").alias("_s"))
    of_all = by_cell.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_on"), F.coalesce(F.sum("_s"), F.lit(0)).alias("_os"))
    held = _best(cells, SCREENING, budgets, False).join(by_cell, "cell_id", "left").groupBy("method", "budget").agg(
        F.count("*").alias("selected_cells"), F.coalesce(F.sum("_n"), F.lit(0)).alias("observable_episodes"), F.coalesce(F.sum("_s"), F.lit(0)).alias("supported_episodes")
    )
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    rate = share("supported_episodes", "observable_episodes")
    both = held.crossJoin(F.broadcast(of_all))  # one row
    return both.select(
        "method", "budget", "selected_cells", "observable_episodes", "supported_episodes", F.round(share("supported_episodes", "_os"), 6).alias("capture_rate"), F.round(rate, 6).alias("support_rate"),
        F.round(F.try_divide(rate, share("_os", "_on")), 6).alias("enrichment"),
    )


def rank_overlap(cells: DataFrame, budget: float = 0.10) -> DataFrame:
    """How far the best tenths of the screening methods agree, for each two methods. Two empty sets agree."""
    best = _best(cells, SCREENING, (budget,), False)
    both = best.groupBy("cell_id").agg(F.collect_set("method").alias("_m"))  # at most one name for each method
    names = list(SCREENING)
    pairs = F.array(*[F.struct(F.lit(a).alias("method_a"), F.lit(b).alias("method_b")) for i, a in enumerate(names) for b in names[i + 1 :]])
    has = lambda x: F.array_contains("_m", x)
    rows = both.select("_m", F.explode(pairs).alias("_p")).select("_m", "_p.*")
    a, b = has(F.col("method_a")), has(F.col("method_b"))
    return rows.groupBy("method_a", "method_b").agg(F.round(F.coalesce(F.try_divide(F.count_if(a & b).cast("double"), F.count_if(a | b)), F.lit(1.0)), 6).alias("overlap"))


def pareto(evaluated: DataFrame) -> DataFrame:
    """Methods of each budget that no other matches in all targets and beats in one."""
    wide = evaluated.groupBy("budget", "method").pivot("kind", ["behavior", "encounter"]).agg(F.first("captured"))
    other = wide.select("budget", F.col("method").alias("_m"), F.col("behavior").alias("_b"), F.col("encounter").alias("_e"))
    beaten = (wide["budget"] == other["budget"]) & (other["_b"] >= wide["behavior"]) & (other["_e"] >= wide["encounter"]) & ((other["_b"] > wide["behavior"]) | (other["_e"] > wide["encounter"]))
    return wide.join(other, beaten, "left_anti")


def fusion_folds(folds: DataFrame, retention: float = 0.95) -> DataFrame:
    """For each fold and budget, whether fusion captures more behaviour than encounters alone and keeps enough encounters. A kind without targets counts as rate 0."""
    pick = lambda method, kind: F.coalesce(F.max(F.when((F.col("method") == method) & (F.col("kind") == kind), F.col("capture_rate"))), F.lit(0.0))
    there = lambda method: F.count_if(F.col("method") == method) > 0
    by = folds.groupBy("fold", "budget").agg(
        pick("fused", "behavior").alias("_fb"), pick("encounter_only", "behavior").alias("_eb"), pick("fused", "encounter").alias("_fe"), pick("encounter_only", "encounter").alias("_ee"),
        (there("fused") & there("encounter_only")).alias("_both"),
    ).where("_both")
    good = (F.col("_fb") > F.col("_eb")) & ((F.col("_ee") == 0) | (F.col("_fe") >= retention * F.col("_ee")))
    return by.select("fold", "budget", good.cast("int").alias("passes"), F.round(F.try_divide(F.col("_fe"), F.col("_ee")), 6).alias("encounter_retention"), F.round(F.col("_fb") - F.col("_eb"), 6).alias("behavior_delta"))


def fusion_gate(folds: DataFrame, retention: float = 0.95, needed: int = 2) -> DataFrame:
    """By budget: in how many folds fusion passes, and whether in most of them; the gate of all is passed with ``needed`` such budgets."""
    by = fusion_folds(folds, retention).groupBy("budget").agg(F.count("*").alias("folds"), F.sum("passes").alias("good_folds"))
    by = by.withColumn("passed", (F.col("good_folds") * 2 > F.col("folds")).cast("int"))
    whole = by.agg((F.coalesce(F.sum("passed"), F.lit(0)) >= needed).cast("int").alias("gate_passed"))
    return by.crossJoin(F.broadcast(whole))  # one row
