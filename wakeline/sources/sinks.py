"""Tables and manifests on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """The fields in this order, with a header; nulls are empty."""
    df.select(*fields).write.option("header", True).option("nullValue", "").mode("overwrite").csv(path)


def write_days(df: DataFrame, path: str, day: str = "date") -> None:
    """A folder for each day. Days that ``df`` holds are replaced as a whole when the job commits, others stay."""
    df.repartition(day).write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Name, bytes and SHA-256 of every file under ``path``, each read by a task of its own."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def manifest_json(files: DataFrame, **about: object) -> str:
    """A manifest of a published bundle, a few dozen files, as one document in the order of their names."""
    rows = [r.asDict() for r in files.orderBy("name").collect()]
    return json.dumps({**about, "file_count": len(rows), "files": rows}, indent=2, sort_keys=True)
