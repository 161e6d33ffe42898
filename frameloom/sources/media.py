"""Source behaviour as operators on rows: reconnects, liveness, presentation times, decoder choice, mock frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The discontinuity threshold, the liveness limit, failures before a fallback and its length (ns).
DISCONTINUITY_NS, LIVENESS_NS = 5_000_000_000, 10_000_000_000
FAILURES, FALLBACK_NS = 3, 60_000_000_000
HARDWARE_PREFIXES = ("nv", "va", "msdk", "amf", "qsv", "d3d11", "d3d12")


def backoff(attempt: Column, kind: str, base_ms: int = 1000, max_ms: int = 30_000) -> Column:
    grown = F.pow(F.lit(2.0), attempt) * base_ms if kind == "Exponential" else (attempt + 1.0) * base_ms
    return F.least(grown, F.lit(float(max_ms))).cast("long")


def pts_kind(pts: Column, order: tuple[str, ...], by: str = "feed_id") -> Column:
    jump = F.abs(pts - F.lag(pts).over(Window.partitionBy(by).orderBy(*order)))
    return F.when(jump.isNull(), F.lit("First")).when(jump > DISCONTINUITY_NS, F.lit("Discontinuity")).otherwise(F.lit("Normal"))


def silences(frames: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Gaps between frames of a feed that the liveness watchdog reports."""
    after = F.lead("ts_ns").over(Window.partitionBy("feed_id").orderBy(*order))
    return frames.withColumn("gap_ns", after - F.col("ts_ns")).filter(F.col("gap_ns") > LIVENESS_NS)


def is_hardware(klass: Column, name: Column) -> Column:
    named = F.lit(False)
    for p in HARDWARE_PREFIXES:
        named = named | F.startswith(F.lower(name), F.lit(p))
    return F.contains(klass, F.lit("Decoder")) & F.contains(klass, F.lit("Video")) & (F.contains(klass, F.lit("Hardware")) | named)


def decode_outcome(preference: Column, hardware: Column) -> Column:
    """``hardware`` is null where the decoder is unknown; requiring hardware fails closed."""
    return (
        F.when((preference == "RequireHardware") & ~F.coalesce(hardware, F.lit(False)), F.lit("Rejected"))
        .when(hardware.isNull(), F.lit("Unknown"))
        .when(hardware, F.lit("Hardware"))
        .otherwise(F.lit("Software"))
    )


def failure_runs(attempts: DataFrame) -> DataFrame:
    """Rows (feed_id, seq, ok) with the number of failures in a row up to each."""
    by_seq = Window.partitionBy("feed_id").orderBy("seq")
    rows = attempts.withColumn("runs", F.sum(F.col("ok").cast("int")).over(by_seq))
    in_run = Window.partitionBy("feed_id", "runs").orderBy("seq")
    return rows.withColumn("failures", F.sum((~F.col("ok")).cast("long")).over(in_run)).drop("runs")


def mock_frames(spark: SparkSession, feed_id: int, count: int, width: int, height: int, interval_ns: int, value: int = 128) -> DataFrame:
    """Deterministic Rgb8 frames of one colour."""
    pixel = F.unhex(F.lit(f"{value:02X}" * 3))
    return spark.range(count).select(
        F.lit(feed_id).cast("long").alias("feed_id"),
        F.col("id").alias("seq"),
        (F.col("id") * interval_ns).alias("ts_ns"),
        F.lit(width).alias("width"),
        F.lit(height).alias("height"),
        F.lit("Rgb8").alias("format"),
        F.unhex(F.repeat(F.hex(pixel), width * height)).alias("data"),
    )


def file_frames(spark: SparkSession, path: str, kind: str = "parquet", streaming: bool = False, schema=None) -> DataFrame:
    """Frames of a file source; a stream of them ends with the files under an AvailableNow trigger."""
    if kind not in ("parquet", "json", "csv", "orc", "binaryFile"):
        raise ValueError(f"not a file source: {kind}")
    reader = spark.readStream if streaming else spark.read
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def custom_frames(spark: SparkSession, kind: str, options: dict[str, str], trusted: bool = False) -> DataFrame:
    """A source by its format name; refused unless the caller says that it is trusted."""
    if not trusted:
        raise PermissionError("custom sources must be trusted explicitly")
    return spark.read.format(kind).options(**options).load()
