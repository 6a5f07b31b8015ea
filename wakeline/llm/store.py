"""What all operators share: files that driver and executors can see, Arrow maps of bounded memory, free column names.

Intermediate tables go to the folder in ``spark.checkpoint.dir``. Unlike a local
checkpoint they outlive the executor that wrote them. Operators delete them as soon as nothing reads them;
those that a result still reads go when the driver's JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Most bytes that go to a Python worker at once, and most rows that the Parquet reader holds: texts are large rows.
ARROW_BYTES, READER_ROWS = 4 << 20, 512


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a new one under the temp folder in local mode, where all is one process; else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="wakeline-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)  # with its scheme, for readers that know no default file system
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString().rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Rows that hold whole texts are read and sent to Python in small lots: by default a lot may have 64 MB, several times for each task."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        spark.conf.set(name, most)


def map_arrow(df: DataFrame, f: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over lots of bounded size."""
    bounded(df.sparkSession)
    return df.mapInArrow(f, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` does not have, so that internal columns never hide the caller's."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


class Scratch:
    """A folder of its own for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        fs, path = self._at(self.path)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, where: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the written table: later steps read it instead of computing it again."""
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        for t in tables:
            fs, path = self._at(t._scratch_path)
            fs.delete(path, True)

    def delete(self, name: str) -> None:
        """Delete a folder of files that tasks wrote here."""
        fs, path = self._at(f"{self.path}/{name}")
        fs.delete(path, True)
