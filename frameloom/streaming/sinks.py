"""Sinks: shared tables for batch and streams, fan-out of a micro-batch, and a listener for stream metrics."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def shared_folder(df: DataFrame) -> str:
    """The folder that all executors share, named by the session."""
    return df.sparkSession.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table below the shared folder, and read back."""
    path = f"{shared_folder(df).rstrip('/')}/frameloom-{name}-{uuid.uuid4().hex}"
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def to_table(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(**(trigger or {"availableNow": True})).start()


def fan_out(stream: DataFrame, sinks: Iterable[Callable[[DataFrame, int], None]], checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch to several sinks, read once."""
    sinks = list(sinks)

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, epoch)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class Progress(StreamingQueryListener):
    """Calls ``report(name, rows a second in, rows a second processed)`` at each progress of a stream."""

    def __init__(self, report: Callable[[str | None, float, float], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report(p.name, p.inputRowsPerSecond, p.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
