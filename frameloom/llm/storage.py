"""Shared, executor-visible tables that cut lineage between the phases of a job."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that Spark hands to Python at once, at most; texts may be long.
BATCH_BYTES = 8 << 20
#: Used only where the session names no spark.checkpoint.dir, as in local tests.
FALLBACK_DIR = "/tmp/checkpoints"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir, else a local one for single-machine runs."""
    return spark.conf.get("spark.checkpoint.dir", None) or FALLBACK_DIR


class Scratch:
    """Tables of one job below the shared folder.

    Each is written by Spark's own committer, so a lost executor only costs the tasks it ran. ``drop`` frees a table
    that nothing reads any more; what remains goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark).rstrip('/')}/frameloom-{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.base))

    def keep(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.option("compression", codec).mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs.delete(self._path(f"{self.base}/{name}"), True)


def text_column(docs: DataFrame, needed: dict[str, str]) -> DataFrame:
    """The needed columns with their types; a column that ``docs`` lacks is null. Other columns are left behind.

    From here on the session hands batches of at most BATCH_BYTES to Python.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    have = set(docs.columns)
    return docs.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(t).alias(c) for c, t in needed.items()])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out
