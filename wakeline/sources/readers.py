"""Files of position reports: CSV (plain, .zst, .zip), Parquet, JSON, GeoJSON, and their checks."""

from __future__ import annotations

import datetime as dt
import io
import math
import os
import shutil
import urllib.request
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of the columns that every later step needs.
ALIASES = {"longitude": ("longitude", "LON", "Lon"), "latitude": ("latitude", "LAT", "Lat"), "mmsi": ("mmsi", "MMSI"), "base_date_time": ("base_date_time", "BaseDateTime", "timestamp"), "sog": ("sog", "SOG"), "cog": ("cog", "COG"), "heading": ("heading", "Heading")}


def days(start: dt.date, end: dt.date) -> list[dt.date]:
    """All days from start to end, both included."""
    if end < start:
        raise ValueError("the end lies before the start")
    return [start + dt.timedelta(days=i) for i in range((end - start).days + 1)]


def daily_file(day: dt.date) -> str:
    """Name of the public daily archive: zstd from 2025 on, zip before."""
    return f"ais-{day:%Y-%m-%d}.csv.zst" if day.year >= 2025 else f"AIS_{day:%Y_%m_%d}.zip"


def canonical(df: DataFrame) -> DataFrame:
    """Columns under their canonical names, whatever the header's spelling."""
    for name, spellings in ALIASES.items():
        there = [s for s in spellings if s in df.columns]
        if there and name not in df.columns:
            df = df.withColumnRenamed(there[0], name)
    return df


def _numbered(df: DataFrame) -> DataFrame:
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All columns as text; ``.csv.zst`` is recognised by its name. A compressed file is one task: crop before anything else."""
    return _numbered(canonical(spark.read.option("header", True).option("inferSchema", False).csv(path)))


def read_zip(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The first CSV member of each archive, in batches of rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(next(n for n in z.namelist() if n.lower().endswith(".csv"))) as f:
                    for part in pd.read_csv(f, dtype=str, keep_default_na=False, chunksize=50_000):
                        yield part.reindex(columns=columns, fill_value="")

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return _numbered(canonical(spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)))


def read_second_source(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Second-source Parquet (lat, lon, POSIX seconds, ...) in canonical columns; the time range prunes row groups."""
    raw = spark.read.parquet(path)
    missing = {"lat", "lon", "timestamp", "mmsi", "sog", "type"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    kept = raw.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    return _numbered(
        kept.select(
            F.col("mmsi").cast("string").alias("mmsi"), F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("base_date_time"),
            F.col("lon").cast("double").alias("longitude"), F.col("lat").cast("double").alias("latitude"), F.col("sog").cast("double").alias("sog"),
            F.lit(None).cast("double").alias("cog"), F.lit(None).cast("double").alias("heading"), vessel_type(F.col("type")).alias("vessel_type"),
        )
    )


def vessel_type(code: Column) -> Column:
    return F.when(code.between(0, 99), code.cast("string"))


def verify(spark: SparkSession, path: str, size: int, md5: str) -> bool:
    """Whether a file has the size and MD5 sum it should have."""
    row = spark.read.format("binaryFile").load(path).select("length", F.md5("content").alias("md5")).first()
    return row is not None and row["length"] == size and row["md5"] == md5


def missing_days(df: DataFrame, start: dt.date, end: dt.date, column: str = "date") -> DataFrame:
    """Days of the range of which there is no row."""
    expected = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias(column))
    return expected.join(df.select(F.col(column).cast("date").alias(column)).distinct(), column, "left_anti")


def dated(df: DataFrame, start: dt.date, end: dt.date, column: str = "date") -> DataFrame:
    """The rows of the days from start to end; a day without any is an error, as a missing daily file would be."""
    rows = df.where(F.col(column).cast("date").between(F.lit(start), F.lit(end)))
    gone = [str(r[0]) for r in missing_days(rows, *(lambda d: (d[0], d[-1]))(days(start, end)), column).orderBy(column).limit(10).collect()]
    if gone:
        raise FileNotFoundError(f"no rows of {', '.join(gone)}")
    return rows


def smoke(df: DataFrame, rows: int) -> DataFrame:
    """The first rows of a source, for a trial run; the limit is the feature."""
    if rows < 1:
        raise ValueError("a trial run needs a row")
    return df.limit(rows)


def read_json(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """A JSON document a file; a missing optional one is an empty table."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if optional and not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_geojson(spark: SparkSession, path: str, properties: str, coordinates: str) -> DataFrame:
    """Features of a collection: their properties, and the geometry under ``geometry``."""
    kind = f"features array<struct<type:string,geometry:struct<type:string,coordinates:{coordinates}>,properties:struct<{properties}>>>"
    return spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties.*", "f.geometry")


def download(url: str, path: str, overwrite: bool = False, chunk: int = 1 << 20) -> str:
    """Fetches a file beside its place and moves it there once it is whole; one that is there already stays unless ``overwrite``."""
    if os.path.exists(path) and not overwrite:
        return path
    part = f"{path}.part"
    try:
        with urllib.request.urlopen(url) as source, open(part, "wb") as out:
            shutil.copyfileobj(source, out, chunk)
            told = source.headers.get("Content-Length")
        if told is not None and os.path.getsize(part) != int(told):
            raise OSError(f"{url}: {os.path.getsize(part)} bytes of {told}")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def inspect_parquet(path: str) -> dict[str, object]:
    """Rows, row groups and column types of a Parquet file, from its footer alone."""
    import pyarrow.parquet as pq

    with pq.ParquetFile(path) as f:
        return {"rows": f.metadata.num_rows, "row_groups": f.metadata.num_row_groups, "columns": {n.name: str(n.type) for n in f.schema_arrow}}


def positions(f: DataFrame, wanted: DataFrame, start: dt.date, end: dt.date, lookahead_min: int = 15, vessel: str = "mmsi") -> DataFrame:
    """Features of the wanted vessels from start to end and as many days more as the look-ahead needs; tracks are named by their day.

    Rows without a track are left out. The vessels meet the features in a semi-join, so their number does not matter.
    """
    last = end + dt.timedelta(days=math.ceil(lookahead_min / 1440))
    there = f.where(F.col("date").between(start.isoformat(), last.isoformat()) & (F.coalesce(F.trim("track_id"), F.lit("")) != ""))
    return there.join(wanted.select(F.col(vessel).alias("mmsi")).distinct(), "mmsi", "left_semi").withColumn("track_id", F.concat_ws("::", "date", "track_id"))


def enrich(features: DataFrame, more: DataFrame, key: str = "cell_id") -> DataFrame:
    """Features with more properties by their key; those without any keep their own, and equal names are replaced where there is a value."""
    both = [c for c in more.columns if c in features.columns and c != key]
    named = more.dropDuplicates([key]).withColumnsRenamed({c: f"_new_{c}" for c in both})
    out = features.join(named, key, "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in both}).drop(*[f"_new_{c}" for c in both])
