"""Counters, gauges and snapshots over output, health and batch rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Health events that add their own delta, and those that no counter counts.
DELTA_KINDS = ("BackpressureDrop", "OutputLagged", "SinkBackpressure", "TrackAdmissionRejected", "BatchSubmissionRejected", "BatchTimeout", "BatchInFlightExceeded", "FrameLag")
UNCOUNTED_KINDS = ("SourceConnected", "SourceEos", "DecodeDecision", "ViewCompensationApplied", "InsecureRtspSource", "ResidencyDowngrade")
STATUS = ("Stable", "Degraded", "Invalid")
# The gauges of a running system, by what they are measured on.
GAUGES = {
    "runtime": ("uptime_seconds", "feed_count", "max_feeds", "output_lag", "output_lag_pending_lost"),
    "feed": (
        "alive", "paused", "uptime_seconds", "frames_received", "frames_dropped", "frames_processed", "tracks_active", "view_epoch", "restarts",
        "queue_source_depth", "queue_source_capacity", "queue_sink_depth", "queue_sink_capacity", "view_stability_score", "view_status",
    ),
    "batch": (
        "dispatched", "items_processed", "items_submitted", "items_rejected", "items_timed_out", "avg_processing_ms", "avg_formation_ms", "avg_fill_ratio",
        "consecutive_errors", "pending_items",
    ),
}


def health_counters(events: DataFrame) -> DataFrame:
    step = F.when(F.col("kind").isin(*DELTA_KINDS), F.coalesce("delta", F.lit(1))).otherwise(F.lit(1))
    return events.filter(~F.col("kind").isin(*UNCOUNTED_KINDS)).groupBy("feed_id", "kind").agg(F.sum(step).cast("long").alias("n"))


def share(part: Column, whole: Column) -> Column:
    """Null where nothing has been counted."""
    return F.when(whole > 0, part / whole)


def batch_metrics(dispatches: DataFrame, max_size: int) -> DataFrame:
    """Per processor, from dispatch rows (size, ok, submitted, rejected, timed_out, formation_ns, processing_ns, dispatch_id).

    ``submitted`` counts all that feeds handed in since the dispatch before: what was taken, rejected, or still waits.
    """
    order = Window.partitionBy("processor_id").orderBy("dispatch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = dispatches.withColumn("run", F.sum(F.col("ok").cast("int")).over(order))
    last = Window.partitionBy("processor_id")
    rows = rows.withColumn("tail", (F.col("run") == F.max("run").over(last)) & ~F.col("ok"))
    g = rows.groupBy("processor_id").agg(
        F.count("*").alias("dispatched"),
        F.sum("size").cast("long").alias("items"),
        F.sum("submitted").cast("long").alias("submitted"),
        F.sum("rejected").cast("long").alias("rejected"),
        F.sum("timed_out").cast("long").alias("timed_out"),
        F.min("size").alias("min_size"),
        F.max("size").alias("max_size"),
        F.count_if("tail").alias("consecutive_errors"),
        F.sum("processing_ns").cast("long").alias("processing_ns"),
        F.sum("formation_ns").cast("long").alias("formation_ns"),
    )
    n = F.col("dispatched")
    return g.withColumns(
        {
            "pending_items": F.greatest(F.col("submitted") - F.col("items") - F.col("rejected"), F.lit(0)),
            "rejection_rate": share(F.col("rejected"), F.col("submitted")),
            "timeout_rate": share(F.col("timed_out"), F.col("submitted")),
            "avg_batch_size": share(F.col("items"), n),
            "avg_fill_ratio": share(F.col("items"), n * max_size),
            "avg_processing_ns": share(F.col("processing_ns"), n),
            "avg_formation_ns": share(F.col("formation_ns"), n),
        }
    )


def status_number(status: Column) -> Column:
    """The place of a view status in STATUS, from 0; null for any other."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STATUS)), status), F.lit(0)) - 1


def gauges(kind: str, rows: DataFrame, subject: Column) -> DataFrame:
    """(gauge, subject, value): every gauge of ``kind`` for each of ``rows``, which have a column for each, named alike.

    Flags count as 0 or 1; an average over nothing is null and gives no row.
    """
    names = {n: f"{kind}.{n}" for n in GAUGES[kind]}
    wide = rows.select(subject.cast("string").alias("subject"), *[F.col(n).cast("double").alias(full) for n, full in names.items()])
    return wide.unpivot("subject", [F.col(f"`{full}`") for full in names.values()], "gauge", "value").filter("value IS NOT NULL")


def batch_gauges(measured: DataFrame) -> DataFrame:
    """Gauges of ``batch_metrics``."""
    named = measured.withColumnsRenamed({"items": "items_processed", "submitted": "items_submitted", "rejected": "items_rejected", "timed_out": "items_timed_out"})
    ms = {f"avg_{n}_ms": F.round(F.col(f"avg_{n}_ns") / 1e6, 6) for n in ("processing", "formation")}
    return gauges("batch", named.withColumns(ms), F.col("processor_id"))


def restarts(events: DataFrame) -> DataFrame:
    """(feed_id, restarts) from health events; feeds that never restarted have no row."""
    return events.filter("kind = 'FeedRestarting'").groupBy("feed_id").agg(F.count("*").alias("restarts"))


def feed_metrics(frames: DataFrame, events: DataFrame) -> DataFrame:
    """Per feed, from frame rows (dropped, tracks, epoch, seq) and health events (kind). Both sides of the join are
    aggregated to one row a feed before it."""
    measured = frames.groupBy("feed_id").agg(
        F.count("*").alias("frames_received"),
        F.count_if("dropped").alias("frames_dropped"),
        F.count_if(~F.col("dropped")).alias("frames_processed"),
        F.max_by("tracks", "seq").alias("tracks_active"),
        F.max("epoch").alias("view_epoch"),
    )
    return measured.join(restarts(events), "feed_id", "left").fillna(0, ["restarts"])


def diagnostics(feeds: DataFrame, processors: DataFrame) -> DataFrame:
    """One row: ``feeds`` and ``processors`` as lists in order of feed_id and of processor_id. Both have one narrow row a
    feed or processor, so the lists are as long as the system has of them, whatever the data."""
    lists = [
        rows.agg(F.array_sort(F.collect_list(F.struct(key, *[c for c in rows.columns if c != key]))).alias(name))
        for rows, key, name in ((feeds, "feed_id", "feeds"), (processors, "processor_id", "batches"))
    ]
    return lists[0].join(lists[1], F.lit(True))  # one row each


def latest(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Each feed's last row."""
    columns = [c for c in rows.columns if c != "feed_id"]
    g = rows.groupBy("feed_id").agg(F.max_by(F.struct(*columns), order).alias("r"))
    return g.select("feed_id", "r.*")
