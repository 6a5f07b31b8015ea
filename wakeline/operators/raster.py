"""Densities and traffic patterns on the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Grid, PatternGates
from ..functions.geo import direction_bin
from ..functions.grid import cell_id, col_row, inside


def on_grid(f: DataFrame, g: Grid) -> DataFrame:
    col, row = col_row(F.col("longitude"), F.col("latitude"), g)
    return f.withColumns({"cell_id": cell_id(F.col("longitude"), F.col("latitude"), g), "col": col, "row": row}).where(F.col("cell_id").isNotNull())


def density(f: DataFrame, g: Grid, *keys: str) -> DataFrame:
    """What each cell (of each key) saw."""
    return on_grid(f, g).groupBy(*keys, "cell_id", "row", "col").agg(
        F.count("*").alias("point_count"), F.count_distinct("mmsi").alias("unique_mmsi"), F.count_distinct("track_id").alias("unique_tracks"), F.round(F.round(F.sum("sog"), 6) / F.count("sog"), 6).alias("mean_sog"),
        F.count_if(F.col("sog") < 0.5).alias("stationary_count"), F.count_if(F.col("sog") >= 0.5).alias("moving_count"), F.count_if(F.col("sog") >= 12).alias("high_speed_count"),
    )


def bins(f: DataFrame, g: Grid, columns: int = 120, rows: int = 120) -> DataFrame:
    """Counts of a picture of so many columns and rows, the first row in the north; reports on the far edges belong to the last ones."""
    x = F.floor((F.col("longitude") - g.west) / (g.east - g.west) * columns).cast("int")
    y = F.floor((F.lit(g.north) - F.col("latitude")) / (g.north - g.south) * rows).cast("int")
    return f.where(inside(F.col("longitude"), F.col("latitude"), g)).groupBy(F.least(x, F.lit(columns - 1)).alias("x"), F.least(y, F.lit(rows - 1)).alias("y")).agg(F.count("*").alias("n"))


def density_norm(daily: DataFrame) -> DataFrame:
    """Daily densities rolled up, relative to the fullest cell. The maximum is an aggregate of its own: a window over all cells would be one task."""
    total = daily.groupBy("cell_id").agg(F.sum("point_count").alias("point_count"), F.sum("moving_count").alias("moving_count"), F.sum("unique_tracks").alias("track_days"))
    return total.crossJoin(F.broadcast(total.agg(F.max("point_count").alias("_m")))).select("cell_id", "point_count", "moving_count", "track_days", F.round(F.col("point_count") / F.col("_m"), 6).alias("density_norm"))


def moving_cells(f: DataFrame, g: Grid, p: PatternGates, *keys: str) -> DataFrame:
    """Cells (of each key) of moving reports with their main direction; of equally common directions the one that was seen first."""
    course = F.coalesce("bearing_deg", "cog")
    moving = on_grid(f.where((F.col("sog") >= p.min_sog) & course.isNotNull()), g).withColumn("bin", direction_bin(course))
    order = F.struct("date", "mmsi", "t", "ordinal")
    by_bin = moving.groupBy(*keys, "cell_id", "row", "col", "bin").agg(F.count("*").alias("n"), F.sum("sog").alias("s"), F.min(order).alias("first"))
    best = Window.partitionBy(*keys, "cell_id").orderBy(F.desc("n"), "first")
    main = by_bin.withColumn("_r", F.row_number().over(best)).groupBy(*keys, "cell_id", "row", "col").agg(F.sum("n").alias("moving_points"), F.sum("s").alias("_s"), F.max(F.when(F.col("_r") == 1, F.col("bin"))).alias("dominant_direction_bin"), F.max("n").alias("_top"))
    seen = moving.groupBy(*keys, "cell_id").agg(F.count_distinct("mmsi").alias("unique_mmsi"), F.count_distinct("track_id").alias("unique_tracks"))
    return main.join(seen, [*keys, "cell_id"]).select(*keys, "cell_id", "row", "col", "moving_points", "unique_mmsi", "unique_tracks", F.round(F.round("_s", 6) / F.col("moving_points"), 6).alias("mean_sog"), "dominant_direction_bin", F.round(F.col("_top") / F.col("moving_points"), 6).alias("dominance_ratio"))


def thresholds(cells: DataFrame, p: PatternGates, *keys: str) -> DataFrame:
    """Limits of each key: values at place floor((n - 1) q) of its cells' sorted counts. The cells of a grid bound every window here."""
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    ranked = cells.select(*keys, "moving_points", (F.row_number().over(by.orderBy("moving_points")) - 1).alias("_i"), F.count("*").over(by).alias("_n"))
    at = lambda q: F.greatest(F.lit(p.min_points).cast("bigint"), F.max(F.when(F.col("_i") == F.floor((F.col("_n") - 1) * q), F.col("moving_points"))))
    return ranked.groupBy(*keys).agg(at(0.75).alias("normal_threshold"), at(0.90).alias("high_threshold"))


def patterns(f: DataFrame, g: Grid, p: PatternGates = PatternGates(), *keys: str) -> DataFrame:
    """Moving cells with flags for regular and for high-confidence routes. A grid bounds the limits, so they are broadcast."""
    cells = moving_cells(f, g, p, *keys)
    limits = F.broadcast(thresholds(cells, p, *keys))
    known = cells.join(limits, list(keys)) if keys else cells.crossJoin(limits)
    enough = F.col("unique_tracks") >= p.min_tracks
    return known.select(*cells.columns, ((F.col("moving_points") >= F.col("normal_threshold")) & enough).cast("int").alias("is_normal"), ((F.col("moving_points") >= F.col("high_threshold")) & enough).cast("int").alias("is_high_confidence"))
