"""How far results hang on thresholds, days and anchors, and what the stages come to."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Encounter, Future, Grid, Matching, PatternGates
from ..functions.geo import propagate
from . import behavior, controls, raster
from .encounters import pairs_brute, pairs_within
from .graph import settled
from .tracks import histogram

#: Lower edges of the calibration bins and their names; the first bin has no lower edge.
CALIBRATION = {
    "dcpa_nm": ((0.25, 0.5, 1.0), ("<0.25", "0.25-<0.5", "0.5-<1.0", ">=1.0")),
    "tcpa_min": ((0.0, 5.0, 10.0, 15.0), ("<0", "0-<5", "5-<10", "10-<15", ">=15")),
    "state_skew_s": ((15.0, 30.0, 45.0, 60.0), ("<15", "15-<30", "30-<45", "45-<60", ">=60")),
    "current_distance_nm": ((0.5, 1.0, 1.5, 2.0), ("<0.5", "0.5-<1.0", "1.0-<1.5", "1.5-<2.0", ">=2.0")),
}
MISSING = "missing_or_undefined"
#: Nested limits of distance and time at closest approach.
NESTED = ((0.25, 5.0), (0.25, 10.0), (0.5, 10.0), (0.5, 15.0))
LEVELS, CELLS = (0.30, 0.35, 0.40, 0.45), (0.003, 0.005, 0.010)


def _percent(n: Column, of: Column) -> Column:
    return F.round(F.try_divide(n * 100.0, of), 6)


def _each(structs: list[Column], name: str) -> Column:
    return F.explode(F.array(*structs)).alias(name)


def score_levels(scored: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Candidates at each least score: all levels from one pass, as conditional counts."""
    one = scored.agg(F.count("*").alias("scored_rows"), *[F.count_if(F.col("anomaly_score") >= x).alias(f"_{i}") for i, x in enumerate(levels)])
    rows = one.select("scored_rows", _each([F.struct(F.lit(x).alias("level"), F.col(f"_{i}").alias("candidates")) for i, x in enumerate(levels)], "p"))
    return rows.select("p.level", "scored_rows", "p.candidates", _percent(F.col("p.candidates"), F.col("scored_rows")).alias("rate_percent"))


def nested_encounters(records: DataFrame, limits: tuple[tuple[float, float], ...] = NESTED) -> DataFrame:
    """Candidates within tighter limits, from one pass over those within the widest."""
    hit = lambda d, t: F.count_if((F.col("dcpa_nm") <= d) & (F.col("tcpa_min") <= t))
    one = records.where("is_candidate = 1").agg(*[hit(d, t).alias(f"_{i}") for i, (d, t) in enumerate(limits)])
    return one.select(_each([F.struct(F.lit(d).alias("dcpa_limit_nm"), F.lit(t).alias("tcpa_limit_min"), F.col(f"_{i}").alias("candidates")) for i, (d, t) in enumerate(limits)], "p")).select("p.*")


def _screened(f: DataFrame, known: DataFrame, g: Grid, least: float, *keys: str) -> DataFrame:
    """Counts of pattern cells and of candidates (of each key)."""
    cells = known.groupBy(*keys).agg(F.sum("is_normal").cast("bigint").alias("normal_cells"), F.sum("is_high_confidence").cast("bigint").alias("high_cells"))
    hits = behavior.score(f, known, g, *keys).groupBy(*keys).agg(F.count("*").alias("scored_rows"), F.count_if(F.col("anomaly_score") >= least).alias("candidates"))
    both = hits.join(cells, list(keys), "left") if keys else hits.crossJoin(F.broadcast(cells))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("normal_cells", "high_cells")}
    return both.withColumns(zero).select(*keys, "normal_cells", "high_cells", "scored_rows", "candidates", _percent(F.col("candidates"), F.col("scored_rows")).alias("rate_percent"))


def cell_sizes(f: DataFrame, g: Grid, p: PatternGates, sizes: tuple[float, ...] = CELLS, least: float = 0.35) -> DataFrame:
    """Patterns and candidates on grids of other cell sizes."""
    out = None
    for size in sizes:
        own = Grid(g.west, g.south, g.east, g.north, size)
        part = _screened(f, raster.patterns(f, own, p), own, least).select(F.lit(size).alias("cell_deg"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def held_out_days(f: DataFrame, known: DataFrame, g: Grid, least: float = 0.35) -> DataFrame:
    """Each day scored with the patterns of the other days. ``known``: patterns by ``fold``, the day left out; it is a column, so all refits are one plan."""
    return _screened(f.withColumn("fold", F.col("date")), known, g, least, "fold").withColumnRenamed("fold", "test_date")


def densest_bins(states: DataFrame, nm: float, n: int = 12) -> DataFrame:
    """The fullest grid times, and whether bucketed pairs equal all pairs there: how many of each, missing and extra."""
    top = states.groupBy("g").agg(F.count("*").alias("vessels")).orderBy(F.desc("vessels"), F.desc("g")).limit(n)
    there = states.join(F.broadcast(top.select("g")), "g", "left_semi")
    side = lambda df, name: df.select("g", "mmsi_a", "mmsi_b", F.lit(1).alias(name))
    both = side(pairs_within(there, nm), "i").join(side(pairs_brute(there, nm), "b"), ["g", "mmsi_a", "mmsi_b"], "full")
    found = both.groupBy("g").agg(F.count("i").alias("indexed"), F.count("b").alias("brute"), F.count_if(F.col("i").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"))
    return top.join(found, "g", "left").select("g", "vessels", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("indexed", "brute", "missing", "extra")])


def synchronised(pairs: DataFrame, e: Encounter = Encounter()) -> DataFrame:
    """Pairs whose states lie close in time, both moved on to the later one; others are left out."""
    skew, later = F.abs(F.col("t_a") - F.col("t_b")), F.greatest("t_a", "t_b")
    moved = {}
    for s in "ab":
        c = lambda n, s=s: F.col(f"{n}_{s}")
        moved[f"lon_{s}"], moved[f"lat_{s}"] = propagate(c("lon"), c("lat"), c("sog"), c("course"), (later - c("t")).cast("double"))
    return pairs.where(skew <= e.max_age_s).withColumns({**moved, "state_skew_s": skew, "t": later})


def differences(pairs: DataFrame, m: Matching = Matching()) -> DataFrame:
    """How far matched anchors are apart in each variable and in all together."""
    gap = lambda v: F.abs(F.col(f"candidate_{v}") - F.col(f"control_{v}"))
    time = F.abs(F.col("candidate_g") - F.col("control_g")).cast("double")
    most = F.greatest(F.lit(1.0), F.abs("candidate_local_exposure"), F.abs("control_local_exposure"))
    total = time / m.time_caliper_s + gap("current_distance_nm") / m.band_nm + gap("relative_speed_kn") / m.speed_caliper_kn + gap("closing_speed_kn") / m.closing_caliper_kn + gap("state_skew_s") / m.skew_norm_s + gap("local_exposure") / most
    fields = {"reference_time_s": time, **{v: gap(v) for v in controls.VALUES}, "normalized_distance": total}
    rows = pairs.select(_each([F.struct(F.lit(k).alias("field"), v.alias("x")) for k, v in fields.items()], "p")).select("p.*")
    q = lambda p: F.round(F.percentile("x", F.lit(p)), 6)
    return rows.groupBy("field").agg(F.count("x").alias("n"), q(0.5).alias("median"), q(0.9).alias("p90"), F.round(F.max("x"), 6).alias("most"))


def _hits(by: list[str], rows: DataFrame, u: Future) -> DataFrame:
    ok = F.col("observable") == 1
    half, one = (F.count_if(ok & (F.col("actual_min_nm") <= nm)) for nm in (u.support_nm, u.near_nm))
    n = F.count_if(ok)
    return rows.groupBy(*by).agg(F.count("*").alias("anchors"), n.alias("observable"), half.alias("within_half_nm"), one.alias("within_one_nm"), F.round(F.try_divide(half, n), 6).alias("half_rate"), F.round(F.try_divide(one, n), 6).alias("one_rate"))


def calibration(judged: DataFrame, u: Future = Future()) -> DataFrame:
    """Later closeness of candidates and controls by bins of what was predicted. ``judged``: anchors with what followed; bins without any are left out."""
    bins = []
    for name, (edges, labels) in CALIBRATION.items():
        at = histogram(F.col(name), [float("-inf"), *edges])
        bins.append(F.struct(F.lit(name).alias("variable"), F.coalesce(F.get(F.array(*map(F.lit, labels)), at), F.lit(MISSING)).alias("bin")))
    return _hits(["variable", "anchor_type", "bin"], judged.select("anchor_type", "observable", "actual_min_nm", _each(bins, "p")).select("*", "p.*"), u)


def composition(judged: DataFrame, nm: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """Of the chosen anchors that came close later, how many were candidates. This is no recall: only chosen anchors are counted."""
    close = lambda x: (F.col("observable") == 1) & (F.col("actual_min_nm") <= x)
    own = F.col("anchor_type") == "candidate"
    one = judged.agg(*[F.count_if(close(x)).alias(f"_n{i}") for i, x in enumerate(nm)], *[F.count_if(close(x) & own).alias(f"_c{i}") for i, x in enumerate(nm)])
    rows = one.select(_each([F.struct(F.lit(x).alias("threshold_nm"), F.col(f"_n{i}").alias("anchors"), F.col(f"_c{i}").alias("candidates")) for i, x in enumerate(nm)], "p")).select("p.*")
    return rows.withColumn("candidate_share", F.round(F.try_divide(F.col("candidates"), F.col("anchors")), 6))


def intervals(pairs: DataFrame, judged: DataFrame, nm: tuple[float, ...] = (0.5, 1.0), m: Matching = Matching()) -> DataFrame:
    """Risk difference and lift by threshold with 95 % intervals, from draws of whole components of pairs that share a pair and day.

    Components with the same numbers of pairs and hits are exchangeable, so the driver gets one row for each distinct triple and draws how often it comes up.
    """
    side = lambda s: judged.select(F.col("anchor_id").alias(f"{s}_id"), F.col("observable").alias(f"{s}_ok"), F.col("actual_min_nm").alias(f"{s}_nm"))
    both = settled(pairs.join(side("candidate"), "candidate_id").join(side("control"), "control_id").where("candidate_ok = 1 AND control_ok = 1"))
    root = controls.dependence(both)
    day = F.concat_ws("|", F.date_format(F.timestamp_seconds("candidate_g"), "yyyy-MM-dd"), F.substring_index("candidate_id", "|", -2))
    levels = F.explode(F.array(*map(F.lit, nm))).alias("threshold_nm")
    hit = lambda s: F.count_if(F.col(f"{s}_nm") <= F.col("threshold_nm"))
    rows = both.withColumn("node", day).join(root, "node").select("root", "candidate_nm", "control_nm", levels)
    triples = rows.groupBy("threshold_nm", "root").agg(F.count("*").alias("n"), hit("candidate").alias("a"), hit("control").alias("b"))
    distinct = triples.groupBy("threshold_nm", "n", "a", "b").agg(F.count("*").alias("times")).orderBy("threshold_nm", "n", "a", "b").toPandas()
    out = []
    for x, d in distinct.groupby("threshold_nm"):
        t, times = d[["n", "a", "b"]].to_numpy(np.int64), d["times"].to_numpy(np.int64)
        drawn = np.random.default_rng(m.seed).multinomial(times.sum(), times / times.sum(), size=m.draws) @ t
        n, a, b = times @ t
        gap = np.percentile((drawn[:, 1] - drawn[:, 2]) / drawn[:, 0], [2.5, 97.5])
        some = drawn[drawn[:, 2] > 0]
        lift = np.percentile(some[:, 1] / some[:, 2], [2.5, 97.5]) if len(some) else (None, None)
        r = lambda v: None if v is None else round(float(v), 6)
        out.append((float(x), int(n), int(times.sum()), r((a - b) / n), r(gap[0]), r(gap[1]), r(a / b) if b else None, r(lift[0]), r(lift[1])))
    names = "threshold_nm double, pairs bigint, components bigint, risk_difference double, difference_low double, difference_high double, lift double, lift_low double, lift_high double"
    return pairs.sparkSession.createDataFrame(out, names)


def daily(f: DataFrame, g: Grid, min_points: int = 20) -> DataFrame:
    """What each day holds: reports, vessels, tracks, cells, the fullest cell, and tracks that are long enough."""
    base = f.groupBy("date").agg(F.count("*").alias("clean_rows"), F.count_distinct("mmsi").alias("unique_mmsi"))
    tracks = f.groupBy("date", "track_id").agg(F.count("*").alias("n")).groupBy("date").agg(F.count("*").alias("tracks"), F.count_if(F.col("n") >= min_points).alias("long_tracks"), F.sum(F.when(F.col("n") >= min_points, F.col("n")).otherwise(0)).alias("long_rows"))
    cells = raster.on_grid(f, g).groupBy("date", "cell_id").agg(F.count("*").alias("n")).groupBy("date").agg(F.count("*").alias("grid_cells"), F.max("n").alias("max_cell_count"))
    return base.join(tracks, "date").join(cells, "date", "left")


def descriptors(days: DataFrame) -> DataFrame:
    """Count, extremes, mean and coefficient of variation over the days of each measure."""
    names = [c for c in days.columns if c != "date"]
    rows = days.select(_each([F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("x")) for c in names], "p")).select("p.*")
    return rows.groupBy("measure").agg(F.count("x").alias("days"), F.min("x").alias("least"), F.round(F.avg("x"), 6).alias("mean"), F.max("x").alias("most"), F.round(F.try_divide(F.stddev_pop("x"), F.avg("x")), 6).alias("cv"), F.round(F.sum("x"), 6).alias("total"))


def day_overlap(density: DataFrame, k: int = 50) -> DataFrame:
    """How far the fullest cells of each day agree with those of the day before and of the first day. Two empty sets agree."""
    ranked = density.withColumn("_r", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("point_count"), "cell_id"))).where(F.col("_r") <= k)
    sets = ranked.groupBy("date").agg(F.collect_set("cell_id").alias("_c"))
    w = Window.partitionBy(F.lit(1)).orderBy("date")  # a row for each day
    both = sets.withColumns({"_p": F.lag("_c").over(w), "_f": F.first("_c").over(w)})
    share = lambda o: F.round(F.coalesce(F.try_divide(F.size(F.array_intersect("_c", o)), F.size(F.array_union("_c", o))), F.lit(1.0)), 6)
    return both.select("date", F.size("_c").alias("cells"), share(F.col("_f")).alias("overlap_first"), F.when(F.col("_p").isNotNull(), share(F.col("_p"))).alias("overlap_previous"))


def stages(**counts: DataFrame) -> DataFrame:
    """Rows that each stage leaves: per cent of the first stage, and how many times fewer. ``counts``: tables in the order of their stages."""
    names = list(counts)
    row = None
    for i, df in enumerate(counts.values()):
        one = df.agg(F.count("*").alias(f"_{i}"))
        row = one if row is None else row.crossJoin(F.broadcast(one))  # one row each
    rows = row.select("_0", _each([F.struct(F.lit(i).alias("stage_no"), F.lit(n).alias("stage"), F.col(f"_{i}").alias("n")) for i, n in enumerate(names)], "p")).select("_0", "p.*")
    return rows.select("stage_no", "stage", "n", _percent(F.col("n"), F.col("_0")).alias("share_percent"), F.round(F.try_divide(F.col("_0"), F.col("n")), 3).alias("ratio"))


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a table whatever the order of its rows: row digests are summed in two lanes, so nothing is collected or sorted."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    h = F.sha2(text, 256)
    lane = lambda at: F.sum(F.conv(F.substr(h, F.lit(at), F.lit(15)), 16, 10).cast("decimal(20,0)")).cast("string")
    parts = df.agg(F.count("*").alias("n_rows"), F.coalesce(lane(1), F.lit("0")).alias("_a"), F.coalesce(lane(16), F.lit("0")).alias("_b"))
    return parts.select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), "_a", "_b"), 256).alias("sha256"))
