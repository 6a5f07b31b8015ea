"""The first steps of the chain on a stream of reports."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Future, Grid, Segmentation
from ..functions.geo import EARTH_RADIUS_NM
from ..functions.grid import cell_id, inside
from ..functions.parse import number, timestamp


def cleaned(stream: DataFrame, g: Grid, late: str = "10 minutes") -> DataFrame:
    """Valid reports, each once within the watermark. Of equal reports any one stays: a stream has no first."""
    lon, lat, sog = (number(stream, c) for c in ("longitude", "latitude", "sog"))
    good = stream.where(F.trim("mmsi").rlike("^[1-9][0-9]{8}$") & inside(lon, lat, g) & sog.between(0, 60))
    timed = good.withColumn("ts", timestamp(F.col("base_date_time"))).where(F.col("ts").isNotNull())
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["mmsi", "ts", "longitude", "latitude"])


def density(clean: DataFrame, g: Grid, window: str = "1 hour") -> DataFrame:
    """Reports, vessels (approximately, as state must be bounded) and mean speed of each cell and window."""
    cell = cell_id(F.col("longitude"), F.col("latitude"), g).alias("cell_id")
    return clean.groupBy(F.window("ts", window), cell).agg(F.count("*").alias("point_count"), F.approx_count_distinct("mmsi").alias("vessels"), F.avg("sog").alias("mean_sog"))


def sessions(candidates: DataFrame, late: str = "30 minutes", gap: str = "15 minutes") -> DataFrame:
    """Encounter episodes of a pair and day as session windows."""
    timed = candidates.withColumn("ts", F.timestamp_seconds("g")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap), "date", "mmsi_a", "mmsi_b").agg(F.count("*").alias("record_count"), F.max("encounter_score").alias("max_score"), F.min("dcpa_nm").alias("min_dcpa_nm"))


def segments(clean: DataFrame, s: Segmentation = Segmentation(), late: str = "10 minutes") -> DataFrame:
    """Segments of each vessel and day on a stream: the rules of the batch features, with the report before as state.

    ``clean``: mmsi, ts (with a watermark), longitude, latitude. Within a micro-batch reports are put in time order; one that comes later than a newer report
    begins a segment as ``non_increasing_time``. A day's state goes when the watermark has passed the last report by a time gap.
    """
    columns = "date string, mmsi string, ts timestamp, segment_break_reason string, seg_no int, point_index int, time_gap_s double, distance_gap_nm double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")  # a vessel's reports of one micro-batch
        before = state.get if state.exists else None
        out = []
        for ts, lon, lat in zip(rows["ts"], rows["longitude"], rows["latitude"], strict=True):
            t, gap, far, reason = ts.timestamp(), None, None, "new_mmsi"
            if before is not None:
                pt, plon, plat, seg, point = before
                gap, far = t - pt, _apart(plon, plat, lon, lat)
                reason = "non_increasing_time" if gap <= 0 else "time_gap" if gap > s.time_gap_s else "distance_gap" if far > s.distance_nm else "implied_speed_gap" if far / (gap / 3600) > s.speed_kn else ""
            seg, point = (1, 0) if before is None else (seg + 1, 0) if reason else (seg, point + 1)
            before = (t, float(lon), float(lat), seg, point)
            out.append((*key, ts, reason, seg, point, gap, None if far is None else round(far, 6)))
        state.update(before)
        state.setTimeoutTimestamp(max(int(before[0] * 1000), state.getCurrentWatermarkMs()) + s.time_gap_s * 1000 + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in columns.split(", ")])

    keyed = clean.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).select("date", "mmsi", "ts", F.col("longitude").cast("double"), F.col("latitude").cast("double"))
    return keyed.groupBy("date", "mmsi").applyInPandasWithState(step, columns, "t double, lon double, lat double, seg int, point int", "append", GroupStateTimeout.EventTimeTimeout)


def _apart(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Nautical miles on the sphere."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_NM * math.asin(min(1.0, math.sqrt(h)))


def followups(episodes: DataFrame, positions: DataFrame, u: Future = Future(), late: str = "30 minutes") -> DataFrame:
    """Later positions of both vessels of an episode, as they come: an interval join of two streams, whose watermarks bound its state.

    ``episodes``: mmsi_a, mmsi_b, t0 (seconds); ``positions``: mmsi, ts, longitude, latitude.
    """
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"mmsi_{s}").alias("vessel")) for s in "ab"])).alias("s")
    asked = episodes.withColumn("ts0", F.timestamp_seconds("t0")).withWatermark("ts0", late).select("mmsi_a", "mmsi_b", "t0", "ts0", side).select("mmsi_a", "mmsi_b", "t0", "ts0", "s.side", "s.vessel")
    seen = positions.withWatermark("ts", late).select("mmsi", "ts", "longitude", "latitude")
    after = (F.col("vessel") == F.col("mmsi")) & (F.col("ts") > F.col("ts0")) & (F.col("ts") <= F.col("ts0") + F.expr(f"INTERVAL {u.lookahead_s} SECONDS"))
    return asked.join(seen, after).select("mmsi_a", "mmsi_b", "t0", "side", "ts", "longitude", "latitude")
