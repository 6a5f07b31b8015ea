"""Matched controls: candidate and control anchors in strata, greedy matching, balance, outcomes."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Matching
from .encounters import islands
from .graph import components as connected

STRATUM = ["date", "hour_block", "block_x", "block_y", "band", "tertile"]
VALUES = ["current_distance_nm", "relative_speed_kn", "closing_speed_kn", "state_skew_s", "local_exposure"]


def strata(records: DataFrame, m: Matching = Matching()) -> DataFrame:
    """Adds the matching stratum: time block, place block, distance band, exposure third of the day (tied middle ranks)."""
    mid = {"lon_mid": (F.col("lon_a") + F.col("lon_b")) / 2, "lat_mid": (F.col("lat_a") + F.col("lat_b")) / 2}
    df = records.withColumns(mid).withColumn("local_cell", F.coalesce("cell_id", F.concat(F.lit("x"), F.floor(F.col("lon_mid") / 0.005), F.lit("_y"), F.floor(F.col("lat_mid") / 0.005))))
    cells = df.groupBy("date", "local_cell").agg(F.count("*").alias("local_exposure"))
    day, tie = Window.partitionBy("date"), Window.partitionBy("date", "local_exposure")
    low = F.rank().over(day.orderBy("local_exposure")) - 1
    mid_rank = ((low + low + F.count("*").over(tie) - 1) / 2 + 0.5) / F.count("*").over(day)
    thirds = cells.select("date", "local_cell", "local_exposure", F.least(F.lit(3), F.floor(mid_rank * 3).cast("int") + 1).alias("tertile"))
    return df.join(thirds, ["date", "local_cell"]).withColumns(
        {"hour_block": F.floor(F.pmod(F.col("g"), F.lit(86400)) / (3600 * m.hours)).cast("int"), "block_x": F.floor(F.col("lon_mid") / m.block_deg).cast("int"), "block_y": F.floor(F.col("lat_mid") / m.block_deg).cast("int"), "band": F.floor(F.col("current_distance_nm") / m.band_nm).cast("int")}
    )


def thinned(times, apart: int):  # noqa: ANN001, ANN201  a Column in, a Column out
    """Of sorted times those at least ``apart`` after the last one kept."""
    keep = lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= apart), F.concat(acc, F.array(x))).otherwise(acc)
    return F.aggregate(times, F.array().cast("array<bigint>"), keep)


def anchors(records: DataFrame, m: Matching = Matching(), gap_s: int = 900) -> DataFrame:
    """First records of candidate episodes (by day), and controls far from the pair's candidates and from each other (across days)."""
    df = strata(records, m)
    pair = Window.partitionBy("mmsi_a", "mmsi_b").orderBy("g")
    when = F.when(F.col("is_candidate") == 1, F.col("g"))
    near = df.withColumns({"_before": F.last(when, ignorenulls=True).over(pair), "_after": F.first(when, ignorenulls=True).over(pair.rowsBetween(0, Window.unboundedFollowing))})
    free = near.where((F.col("is_candidate") == 0) & (F.coalesce(F.col("g") - F.col("_before") > m.exclusion_s, F.lit(True))) & (F.coalesce(F.col("_after") - F.col("g") > m.exclusion_s, F.lit(True)))).drop("_before", "_after")
    times = free.groupBy("mmsi_a", "mmsi_b").agg(F.array_sort(F.collect_list("g")).alias("_t")).select("mmsi_a", "mmsi_b", F.explode(thinned(F.col("_t"), m.thinning_s)).alias("g"))
    controls = free.join(times, ["mmsi_a", "mmsi_b", "g"]).withColumns({"anchor_type": F.lit("control"), "record_count": F.lit(1).cast("bigint")})
    w = Window.partitionBy("date", "mmsi_a", "mmsi_b", "island")
    first = islands(df.where("is_candidate = 1"), gap_s).withColumns({"_r": F.row_number().over(w.orderBy("g")), "record_count": F.count("*").over(w)}).where("_r = 1").drop("_r", "island").withColumn("anchor_type", F.lit("candidate"))
    ident = F.concat_ws("|", F.format_string("%012d", "g"), "mmsi_a", "mmsi_b")
    return first.unionByName(controls).withColumn("anchor_id", ident)


def match(found: DataFrame, m: Matching = Matching()) -> DataFrame:
    """Within each stratum every candidate, in order, takes the nearest control within the calipers that is still free."""
    columns = [*STRATUM, "anchor_id", "g", *VALUES]
    kind = ", ".join(f"{a}_{c} {t}" for a in ("candidate", "control") for c, t in [("id", "string"), ("g", "bigint"), *[(v, "double") for v in VALUES]])

    def greedy(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("anchor_id"), right.sort_values(["g", "anchor_id"])
        g, ids, free = right["g"].to_numpy(np.int64), right["anchor_id"].to_numpy(str), np.ones(len(right), bool)
        distance, speed, closing, skew, exposure = (right[v].to_numpy(np.float64) for v in VALUES)
        out = []
        for c in left.itertuples(index=False):
            near = slice(*np.searchsorted(g, [c.g - m.time_caliper_s, c.g + m.time_caliper_s + 1]))  # the time caliper as a window of the sorted controls
            ds, dc = np.abs(speed[near] - c.relative_speed_kn), np.abs(closing[near] - c.closing_speed_kn)
            ok = near.start + np.flatnonzero(free[near] & (ds <= m.speed_caliper_kn) & (dc <= m.closing_caliper_kn))
            if not len(ok):
                continue
            most = np.maximum(np.abs(exposure[ok]), max(1.0, abs(c.local_exposure)))
            terms = [
                np.abs(g[ok] - c.g) / m.time_caliper_s, np.abs(distance[ok] - c.current_distance_nm) / m.band_nm, np.abs(speed[ok] - c.relative_speed_kn) / m.speed_caliper_kn,
                np.abs(closing[ok] - c.closing_speed_kn) / m.closing_caliper_kn, np.abs(skew[ok] - c.state_skew_s) / m.skew_norm_s, np.abs(exposure[ok] - c.local_exposure) / most,
            ]
            pick = ok[np.lexsort([ids[ok], *reversed(terms), sum(terms)])[0]]
            free[pick] = False
            out.append((c.anchor_id, c.g, *[float(getattr(c, v)) for v in VALUES], ids[pick], int(g[pick]), *[float(x[pick]) for x in (distance, speed, closing, skew, exposure)]))
        return pd.DataFrame(out, columns=[x.split()[0] for x in kind.split(", ")])

    whole = found.where(" AND ".join(f"{v} IS NOT NULL" for v in VALUES)).select("anchor_type", *columns)
    side = lambda s: whole.where(F.col("anchor_type") == s).select(*[F.col(c).alias(c) for c in whole.columns]).groupBy(*STRATUM)  # noqa: E731  new columns, or both sides would be taken for one
    return side("candidate").cogroup(side("control")).applyInPandas(greedy, kind)


def balance(found: DataFrame, pairs: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """How alike candidates and controls are in each variable: before matching, after it and, with ``judged``, among pairs of which both sides can be judged.

    Counts of values that are there and missing, mean, median, 90 % value, and the standardised mean difference: by the root of the mean of those sample variances
    that exist; 0 where means agree without spread, null where they differ without spread.
    """
    day = lambda g: F.pmod(g, F.lit(86400)).cast("double")
    of = {**{v: lambda p, v=v: F.col(f"{p}{v}").cast("double") for v in VALUES}, "time_of_day_s": lambda p: day(F.col(f"{p}g"))}
    long = lambda df, p, side, phase: df.select(F.lit(phase).alias("phase"), side.alias("side"), F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), x(p).alias("x")) for v, x in of.items()])).alias("e")).select("phase", "side", "e.*")
    rows = long(found, "", F.col("anchor_type"), "pre")
    sides = ("candidate", "control")
    matched = [("post", pairs)]
    if judged is not None:
        can = lambda s: judged.where("observable = 1").select(F.col("anchor_id").alias(f"{s}_id"))
        matched.append(("joint", pairs.join(can("candidate"), "candidate_id", "left_semi").join(can("control"), "control_id", "left_semi")))
    for phase, df in matched:
        for side in sides:
            rows = rows.unionByName(long(df, f"{side}_", F.lit(side), phase))
    own = {s: F.when(F.col("side") == s, F.col("x")) for s in sides}
    q = lambda s, p: F.round(F.percentile(own[s], F.lit(p)), 6)
    a, b = (F.var_samp(own[s]) for s in sides)
    pooled = F.sqrt(F.coalesce((a + b) / 2, a, b))
    gap = F.avg(own["candidate"]) - F.avg(own["control"])
    smd = F.when(gap == 0, F.lit(0.0)).otherwise(F.try_divide(gap, pooled))
    columns = []
    for s in sides:
        missing = F.count_if((F.col("side") == s) & F.col("x").isNull())
        columns += [F.count(own[s]).alias(f"{s}_n"), missing.alias(f"{s}_missing"), F.round(F.avg(own[s]), 6).alias(f"{s}_mean"), q(s, 0.5).alias(f"{s}_median"), q(s, 0.9).alias(f"{s}_p90")]
    return rows.groupBy("phase", "variable").agg(*columns, F.round(smd, 6).alias("smd"))


def observability(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """Of all pairs: judged on both sides, and of those observable on both, on one side or on neither."""
    side = lambda s: judged.select(F.col("anchor_id").alias(f"{s}_id"), F.col("observable").alias(f"{s}_ok"))
    both = pairs.join(side("candidate"), "candidate_id", "left").join(side("control"), "control_id", "left")
    a, b = F.col("candidate_ok"), F.col("control_ok")
    n = lambda x, y: F.count_if((a == x) & (b == y))
    return both.agg(
        F.count("*").alias("pairs"), F.count_if(a.isNotNull() & b.isNotNull()).alias("judged"), n(1, 1).alias("both"), n(1, 0).alias("candidate_only"), n(0, 1).alias("control_only"), n(0, 0).alias("neither"),
    )


def outcomes(pairs: DataFrame, judged: DataFrame, nm: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """Rates of later closeness among pairs of which both sides can be judged, by threshold. ``judged``: anchor_id, observable, actual_min_nm."""
    side = lambda s: judged.select(F.col("anchor_id").alias(f"{s}_id"), F.col("observable").alias(f"{s}_ok"), F.col("actual_min_nm").alias(f"{s}_nm"))
    both = pairs.join(side("candidate"), "candidate_id").join(side("control"), "control_id").where("candidate_ok = 1 AND control_ok = 1")
    rows = both.crossJoin(F.broadcast(both.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, nm))).alias("threshold_nm"))))
    hit = lambda s: F.count_if(F.col(f"{s}_nm") <= F.col("threshold_nm"))
    a, b, n = hit("candidate"), hit("control"), F.count("*")
    return rows.groupBy("threshold_nm").agg(n.alias("pairs"), a.alias("candidate_hits"), b.alias("control_hits"), F.round((a - b) / n, 6).alias("risk_difference"), F.round(F.try_divide(a, b), 6).alias("lift"))


def dependence(pairs: DataFrame) -> DataFrame:
    """Components of pair-days that matches tie together: the units of the bootstrap."""
    day = lambda s: F.concat_ws("|", F.date_format(F.timestamp_seconds(f"{s}_g"), "yyyy-MM-dd"), F.substring_index(f"{s}_id", "|", -2))
    return connected(pairs.select(day("candidate").alias("a"), day("control").alias("b")))


def bootstrap(triples: list[tuple[int, int, int]], m: Matching = Matching()) -> dict[str, tuple[float, float] | None]:
    """95 % intervals of risk difference and lift. ``triples``: pairs, candidate hits, control hits of each component, in the order of their roots; a few thousand at most."""
    rng = random.Random(m.seed)
    diff, lift = [], []
    for _ in range(m.draws):
        drawn = rng.choices(triples, k=len(triples))
        n, a, b = (sum(t[i] for t in drawn) for i in range(3))
        if n:
            diff.append((a - b) / n)
        if b:
            lift.append(a / b)
    return {"risk_difference": _interval(diff), "lift": _interval(lift)}


def _interval(values: list[float]) -> tuple[float, float] | None:
    if not values:
        return None
    values = sorted(values)

    def at(q: float) -> float:
        x = (len(values) - 1) * q
        i = int(x)
        return values[i] + (values[min(i + 1, len(values) - 1)] - values[i]) * (x - i)

    return round(at(0.025), 6), round(at(0.975), 6)
