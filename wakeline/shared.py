"""Tables in the folder that driver and executors share: where plans of several stages meet."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a new one under the temp folder in local mode, where all is one process; else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="wakeline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _file(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, cut from its lineage, there still if an executor is lost. It goes with the driver's JVM, or earlier by ``forget``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _file(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    fs, p = _file(df.sparkSession, df._written_path)
    fs.delete(p, True)


def stamp(spark: SparkSession, path: str) -> tuple:
    """Name, length and time of change of a table's files: whether it is still the same."""
    fs, p = _file(spark, path)
    return tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)) if fs.exists(p) else ()
