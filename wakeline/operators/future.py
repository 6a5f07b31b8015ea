"""What strictly later positions say about predicted encounters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Future
from ..functions.geo import distance_nm, norm, plane
from .graph import settled

KEY = ["date", "mmsi_a", "mmsi_b", "t0"]


def followup(episodes: DataFrame, f: DataFrame, u: Future = Future()) -> DataFrame:
    """Positions of both vessels in (t0, t0 + lookahead], by an equi-join on vessel and time bucket."""
    pos = f.select(F.col("mmsi").alias("vessel"), F.floor(F.col("t") / u.lookahead_s).alias("_b"), "t", "ordinal", "longitude", "latitude", F.concat_ws("::", "date", "track_id").alias("track"))
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("mmsi_a").alias("vessel")), F.struct(F.lit("b").alias("side"), F.col("mmsi_b").alias("vessel")))).alias("s")
    buckets = F.explode(F.array(F.floor(F.col("t0") / u.lookahead_s), F.floor(F.col("t0") / u.lookahead_s) + 1)).alias("_b")
    asked = episodes.select(*KEY, sides).select(*KEY, "s.side", "s.vessel").select("*", buckets)
    return asked.join(pos, ["vessel", "_b"]).where((F.col("t") > F.col("t0")) & (F.col("t") <= F.col("t0") + u.lookahead_s)).drop("_b", "vessel")


def edges(after: DataFrame, u: Future = Future()) -> DataFrame:
    """Straight pieces between neighbouring later positions of one track."""
    w = Window.partitionBy(*KEY, "side").orderBy("t", "ordinal")
    lead = lambda c: F.lead(c).over(w)
    e = after.select(*KEY, "side", F.col("t").alias("s"), lead("t").alias("e"), F.col("longitude").alias("x0"), F.col("latitude").alias("y0"), lead("longitude").alias("x1"), lead("latitude").alias("y1"), "track", lead("track").alias("_next"))
    return e.where((F.col("track") == F.col("_next")) & (F.col("e") > F.col("s")) & (F.col("e") - F.col("s") <= u.max_edge_s)).drop("track", "_next")


def overlaps(e: DataFrame) -> DataFrame:
    """Times that edges of both sides share, with the least distance in each: a closed form, as the relative motion is linear."""
    one = lambda s: e.where(F.col("side") == s).select(*KEY, *[F.col(c).alias(f"{c}_{s}") for c in ("s", "e", "x0", "y0", "x1", "y1")])
    both = one("a").join(one("b"), KEY).withColumns({"s": F.greatest("s_a", "s_b"), "e": F.least("e_a", "e_b")}).where(F.col("s") < F.col("e"))
    at = {}
    for v in "ab":
        for name, t in (("0", "s"), ("1", "e")):
            part = (F.col(t) - F.col(f"s_{v}")) / (F.col(f"e_{v}") - F.col(f"s_{v}"))
            for c in "xy":
                at[f"p{c}{name}{v}"] = F.col(f"{c}0_{v}") + (F.col(f"{c}1_{v}") - F.col(f"{c}0_{v}")) * part
    both = both.withColumns(at)
    c = F.col
    mid_x, mid_y = ((c(f"p{k}0a") + c(f"p{k}0b") + c(f"p{k}1a") + c(f"p{k}1b")) / 4 for k in "xy")
    (ax0, ay0), (bx0, by0), (ax1, ay1), (bx1, by1) = (plane(c(f"px{n}{v}"), c(f"py{n}{v}"), mid_x, mid_y) for n in "01" for v in "ab")
    both = both.withColumns({"rx": bx0 - ax0, "ry": by0 - ay0, "dx": (bx1 - ax1) - (bx0 - ax0), "dy": (by1 - ay1) - (by0 - ay0)})
    d2 = c("dx") * c("dx") + c("dy") * c("dy")
    both = both.withColumn("part", F.when(d2 > 1e-18, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -((c("rx") * c("dx") + c("ry") * c("dy")) / d2)))).otherwise(0.0))
    return both.select(*KEY, "s", "e", norm(c("rx") + c("dx") * c("part"), c("ry") + c("dy") * c("part")).alias("d"), (c("s") + c("part") * (c("e") - c("s"))).alias("at"))


def samples(after: DataFrame, e: DataFrame, step_s: int) -> DataFrame:
    """Distances at scheduled times: an observation at the time counts, else a place on an edge."""
    first = F.floor((F.col("s") - F.col("t0")) / step_s) + 1
    last = F.ceil((F.col("e") - F.col("t0")) / step_s) - 1
    on = e.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    part = (F.col("t0") + F.col("k") * step_s - F.col("s")) / (F.col("e") - F.col("s"))
    on = on.select(*KEY, "side", "k", (F.col("x0") + (F.col("x1") - F.col("x0")) * part).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * part).alias("y"))
    hit = after.where(F.pmod(F.col("t") - F.col("t0"), F.lit(step_s)) == 0).groupBy(*KEY, "side", F.floor((F.col("t") - F.col("t0")) / step_s).alias("k")).agg(F.min_by(F.struct("longitude", "latitude"), "ordinal").alias("p")).select(*KEY, "side", "k", F.col("p.longitude").alias("x"), F.col("p.latitude").alias("y"))
    there = on.unionByName(hit)
    one = lambda s: there.where(F.col("side") == s).select(*KEY, "k", F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}"))
    return one("a").join(one("b"), [*KEY, "k"]).withColumn("d", distance_nm(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b")))


def backtest(episodes: DataFrame, f: DataFrame, u: Future = Future()) -> DataFrame:
    """Every episode with what followed: coverage, least distance, whether it can be judged and is supported."""
    after = settled(followup(episodes, f, u))  # five branches read it, three its edges
    e = settled(edges(after, u))
    o = overlaps(e)
    w = Window.partitionBy(*KEY).orderBy("s")
    gaps = o.withColumn("_gap", F.col("s") - F.coalesce(F.lag("e").over(w), F.col("t0")))
    cover = gaps.groupBy(*KEY).agg(F.sum(F.col("e") - F.col("s")).alias("coverage_s"), F.greatest(F.max("_gap"), F.first("t0") + u.lookahead_s - F.max("e")).alias("gap_s"), F.min("d").alias("continuous"), F.min_by("at", "d").alias("at"))
    grid = samples(after, e, u.step_s).groupBy(*KEY).agg(F.count("*").alias("n"), F.min("d").alias("sampled"))
    seen = after.groupBy(*KEY).agg(F.count_if(F.col("side") == "a").alias("observations_a"), F.count_if(F.col("side") == "b").alias("observations_b"))
    zero = lambda c, v=0: F.coalesce(c, F.lit(v))
    df = episodes.join(cover, KEY, "left").join(grid, KEY, "left").join(seen, KEY, "left")
    df = df.withColumns({"coverage_s": zero("coverage_s"), "uncovered_s": zero("gap_s", u.lookahead_s), "samples": zero("n"), "observations_a": zero("observations_a"), "observations_b": zero("observations_b"), "actual_min_nm": F.round(F.coalesce("continuous", "sampled"), 6)})
    scheduled = -(-u.lookahead_s // u.step_s)
    can = lambda share: (F.col("actual_min_nm").isNotNull() & (F.col("samples") >= F.ceil(F.lit(scheduled * share))) & (F.col("coverage_s") >= u.lookahead_s * share) & (F.col("uncovered_s") <= u.max_uncovered_s))
    df = df.withColumns({"observable_50": can(0.5).cast("int"), "observable": can(u.min_fraction).cast("int"), "observable_90": can(0.9).cast("int")})
    ok = F.col("observable") == 1
    status = F.when(~ok, "insufficient_synchronized_future_followup").when(F.col("actual_min_nm") <= u.support_nm, "future_supported_within_threshold").otherwise("future_observable_not_within_threshold")
    return df.withColumns(
        {
            "supported": (ok & (F.col("actual_min_nm") <= u.support_nm)).cast("int"), "near_supported": (ok & (F.col("actual_min_nm") <= u.near_nm)).cast("int"), "status": status,
            "distance_error_nm": F.when(ok, F.round(F.abs(F.col("actual_min_nm") - F.col("dcpa_nm")), 6)),
            "time_error_min": F.when(ok, F.round(F.abs(F.col("at") - F.col("t0") - F.col("tcpa_min") * 60) / 60, 6)),
        }
    ).drop("gap_s", "n", "continuous", "sampled", "at")


def backtest_summary(b: DataFrame) -> DataFrame:
    rate = lambda a, n: F.round(F.try_divide(F.sum(a).cast("double"), n), 6)
    return b.agg(
        F.count("*").alias("episodes"), F.sum("observable").alias("observable"), F.sum("supported").alias("supported"), F.sum("near_supported").alias("near_supported"),
        rate("observable", F.count("*")).alias("observable_rate"), rate("supported", F.sum("observable")).alias("support_rate"), rate("near_supported", F.sum("observable")).alias("near_rate"),
        F.sum("observable_50").alias("observable_50"), F.sum("observable_90").alias("observable_90"),
        F.round(F.percentile("coverage_s", F.lit(0.5)), 6).alias("median_coverage_s"), F.round(F.percentile("distance_error_nm", F.lit(0.5)), 6).alias("median_distance_error_nm"), F.round(F.percentile("distance_error_nm", F.lit(0.9)), 6).alias("p90_distance_error_nm"),
    )


def backtest_status(b: DataFrame) -> DataFrame:
    """Episodes of each status, with coverage and errors: 10 %, middle and 75 % values of coverage, 90 % value of the error in time."""
    q = lambda c, p: F.round(F.percentile(c, F.lit(p)), 6)
    return b.groupBy("status").agg(
        F.count("*").alias("episodes"), q("coverage_s", 0.1).alias("p10_coverage_s"), q("coverage_s", 0.5).alias("median_coverage_s"), q("coverage_s", 0.75).alias("p75_coverage_s"),
        q("distance_error_nm", 0.75).alias("p75_distance_error_nm"), F.min("actual_min_nm").alias("least_actual_nm"),
    )


def backtest_examples(b: DataFrame, n: int = 10) -> DataFrame:
    """The supported episodes that came closest; the limit is the feature."""
    return b.where("supported = 1").orderBy("actual_min_nm", *KEY).limit(n)


def grid_sensitivity(episodes: DataFrame, f: DataFrame, steps: tuple[int, ...] = (10, 30, 60), u: Future = Future()) -> DataFrame:
    """Common samples and least sampled distance for several steps, from one set of samples of the finest."""
    after = settled(followup(episodes, f, u))
    fine = samples(after, edges(after, u), min(steps))
    every = F.explode(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: F.pmod(F.col("k") * min(steps), s) == 0)).alias("step_s")
    return fine.select("*", every).groupBy("step_s").agg(F.count("*").alias("samples"), F.count_distinct(F.struct(*KEY)).alias("episodes"), F.round(F.min("d"), 6).alias("least_nm"))
