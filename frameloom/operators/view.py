"""Camera view-state: sources of motion, epoch decisions, transition phases, validity and stability per feed.

Input rows: feed_id, seq, pan, tilt, zoom (null without telemetry), conf (null without a transform), disp, preset, hint.
Every operator is a window over one feed's reports in order of seq.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from frameloom.functions.geometry import angular_delta
from frameloom.operators.folds import fold_rows


def by_seq() -> WindowSpec:
    return Window.partitionBy("feed_id").orderBy("seq")


def so_far() -> WindowSpec:
    return by_seq().rowsBetween(Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class EpochPolicy:
    """Thresholds in degrees, zoom units and image sides. Subclasses may override ``decide``."""

    segment_angle: float = 15.0
    segment_zoom: float = 0.3
    segment_displacement: float = 0.25
    compensate_confidence: float = 0.8
    deadband: float = 0.01
    degrade_on_small: bool = True

    def decide(self) -> Column:
        """Struct (decision, reason) of a row with before_pan, before_tilt, before_zoom and motion."""
        pan, tilt = (angular_delta(F.col(c), F.col(f"before_{c}")) for c in ("pan", "tilt"))
        zoom = F.abs(F.col("zoom") - F.col("before_zoom"))
        trusted = F.coalesce(F.col("conf") >= self.compensate_confidence, F.lit(False))

        def outcome(decision: str, reason: str | None = None) -> Column:
            return F.struct(F.lit(decision).alias("decision"), F.lit(reason).cast("string").alias("reason"))

        def jump(reason: str) -> Column:
            return F.when(trusted, outcome("Compensate", reason)).otherwise(outcome("Segment"))

        known = F.col("before_pan").isNotNull() & F.col("pan").isNotNull()
        far = known & ((pan > self.segment_angle) | (tilt > self.segment_angle) | (zoom > self.segment_zoom))
        near = known & ((pan > self.deadband) | (tilt > self.deadband) | (zoom > self.deadband)) & F.lit(self.degrade_on_small)
        shift = F.when(F.col("motion") == "Moving", F.col("disp"))
        return (
            F.when(F.col("preset"), outcome("Segment"))
            .when(far, jump("PtzMoving"))
            .when(near, outcome("Degrade", "PtzMoving"))
            .when(shift > self.segment_displacement, jump("LargeJump"))
            .when((shift > 0) & F.lit(self.degrade_on_small), outcome("Degrade", "InferredMotionLowConfidence"))
            .otherwise(outcome("Continue"))
        )


def motion_source() -> Column:
    return F.when(F.col("pan").isNotNull(), "Telemetry").when(F.col("conf").isNotNull(), "Inferred").otherwise("None")


def motion_state() -> Column:
    """A hint wins; else a trusted transform tells; telemetry alone leaves the state unknown."""
    inferred = F.when(F.col("disp") < 0.01, "Stable").otherwise("Moving")
    return F.coalesce(F.col("hint"), F.when(F.col("conf") > 0.5, inferred), F.lit("Unknown"))


def decided(reports: DataFrame, policy: EpochPolicy | None = None) -> DataFrame:
    """``reports`` with source, motion, decision and reason; the report before counts even if it has no telemetry."""
    before = {f"before_{c}": F.lag(c).over(by_seq()) for c in ("pan", "tilt", "zoom")}
    rows = reports.withColumns(before | {"source": motion_source(), "motion": motion_state()})
    rows = rows.withColumn("outcome", (policy or EpochPolicy()).decide())
    return rows.withColumns({"decision": F.col("outcome.decision"), "reason": F.col("outcome.reason")}).drop("outcome", *before)


def phase() -> Column:
    moving = F.col("motion") != "Stable"
    before = F.lag(moving | (F.col("decision") == "Segment"), 1, False).over(by_seq())
    return (
        F.when(F.col("decision") == "Segment", "MoveStart")
        .when(moving & before, "Moving")
        .when(moving, "MoveStart")
        .when(before, "MoveEnd")
        .otherwise("Settled")
    )


def epoch(initial: int = 0) -> Column:
    return initial + F.sum((F.col("decision") == "Segment").cast("long")).over(so_far())


def version() -> Column:
    return F.row_number().over(by_seq()).cast("long")


def validity() -> Column:
    """Valid, or Degraded with a reason; a frame that neither degrades nor settles leaves it as it was."""
    worse = F.col("decision").isin("Degrade", "Compensate")
    valid = (F.col("decision") == "Segment") | (F.col("motion") == "Stable")
    now = F.when(worse, F.concat(F.lit("Degraded:"), F.col("reason"))).when(valid, F.lit("Valid"))
    return F.coalesce(F.last(now, ignorenulls=True).over(so_far()), F.lit("Degraded:Unknown"))


def stability_steps() -> dict[str, Column]:
    """Each frame maps the score to clamp(score + add, low, high)."""
    d, settled = F.col("decision"), F.col("motion") == "Stable"
    up = (d == "Continue") & settled
    return {
        "add": F.when(up, 0.1).when(d == "Degrade", -0.2).when(d == "Compensate", -0.1).otherwise(0.0),
        "low": F.lit(0.0),
        "high": F.when(d == "Segment", 0.0).otherwise(1.0),
    }


def stability(rows: DataFrame, initial: float = 0.0) -> DataFrame:
    """(feed_id, seq, stability): the score after each frame, a running sum clamped at both bounds."""
    steps = rows.select("feed_id", "seq", *[c.cast("double").alias(n) for n, c in stability_steps().items()])

    def step(score: list[float], r: dict) -> list[tuple]:
        score[0] = max(r["low"], min(r["high"], score[0] + r["add"]))
        return [(r["feed_id"], r["seq"], score[0])]

    return fold_rows(steps, ["feed_id"], ["seq"], lambda: [initial], step, "feed_id long, seq long, stability double")


def since_change() -> Column:
    """Nanoseconds since the kind of motion last changed."""
    changed = F.coalesce(F.col("motion") != F.lag("motion").over(by_seq()), F.lit(True))
    return F.col("ts_ns") - F.last(F.when(changed, F.col("ts_ns")), ignorenulls=True).over(so_far())


def fixed_view(frames: DataFrame) -> DataFrame:
    """A fixed camera's view: always stable and valid."""
    return frames.withColumns({"motion": F.lit("Stable"), "source": F.lit("None"), "validity": F.lit("Valid"), "stability": F.lit(1.0), "epoch": F.lit(0).cast("long")})


def bound_validity(bound_version: Column, bound_epoch: Column, version: Column, epoch: Column) -> Column:
    return (
        F.when(bound_version == version, F.lit("Current"))
        .when(bound_epoch == epoch, F.concat(F.lit("StaleWithinEpoch:"), F.greatest(version - bound_version, F.lit(0)).cast("string")))
        .otherwise(F.concat(F.lit("InvalidAcrossEpoch:"), F.greatest(epoch - bound_epoch, F.lit(0)).cast("string")))
    )
