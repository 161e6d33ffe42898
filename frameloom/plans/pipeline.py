"""Linear stage pipelines: declared stages, checked before a plan is built, applied in order, merged by kind.

A stage is a function of frame rows. Detections and tracks replace what earlier stages gave, signals and features add
to it, artifacts are kept by type, the last one winning. A stage's error drops the frame: later stages, the output and
the store do not see it, but it counts as processed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """``apply`` maps rows to rows; what it ``consumes`` must be produced by an earlier stage."""

    stage_id: str
    apply: Callable[[DataFrame], DataFrame]
    consumes: frozenset[str] = frozenset()
    produces: frozenset[str] = frozenset()


@dataclass
class Pipeline:
    """Stages before a shared batch stage, that stage, and stages after it."""

    before: list[Stage] = field(default_factory=list)
    batch: Stage | None = None
    after: list[Stage] = field(default_factory=list)

    def stages(self) -> list[Stage]:
        return [*self.before, *([self.batch] if self.batch else []), *self.after]

    def add(self, stage: Stage) -> Pipeline:
        (self.after if self.batch else self.before).append(stage)
        return self

    def with_batch(self, stage: Stage) -> Pipeline:
        if self.batch:
            raise ValueError("a pipeline has one batch stage")
        self.batch = stage
        return self

    def problems(self) -> list[str]:
        have: set[str] = set()
        seen: set[str] = set()
        out = []
        for s in self.stages():
            if s.stage_id in seen:
                out.append(f"stage {s.stage_id} appears twice")
            out += [f"stage {s.stage_id} needs {c}, which no earlier stage produces" for c in sorted(s.consumes - have)]
            seen.add(s.stage_id)
            have |= s.produces
        return out

    def run(self, frames: DataFrame, check: str = "Error") -> DataFrame:
        """``check``: Off, Warn or Error."""
        if not self.stages():
            raise ValueError("a pipeline needs a stage")
        if check != "Off" and (found := self.problems()):
            if check == "Error":
                raise ValueError("; ".join(found))
            import warnings

            warnings.warn("; ".join(found), stacklevel=2)
        for s in self.stages():
            frames = frames.transform(s.apply)
        return frames


@dataclass(frozen=True)
class FeedConfig:
    """What a feed needs before it may start; ``problems`` lists what is wrong with it."""

    source: str | None = None
    camera_mode: str | None = None
    pipeline: Pipeline | None = None
    sink: Callable | None = None
    view_provider: object | None = None
    queue_depth: int = 4
    sink_capacity: int = 16
    trusted: bool = False
    require_tls: bool = False

    def problems(self) -> list[str]:
        out = [f"{n} is missing" for n in ("source", "camera_mode", "pipeline", "sink") if getattr(self, n) is None]
        if self.pipeline and not self.pipeline.stages():
            out.append("the pipeline has no stage")
        if self.camera_mode == "Observed" and self.view_provider is None:
            out.append("an observed camera needs a view provider")
        if self.camera_mode == "Fixed" and self.view_provider is not None:
            out.append("a fixed camera takes no view provider")
        if self.queue_depth < 1:
            out.append("a queue holds at least one element")
        if self.source and self.source.startswith("rtsp://") and self.require_tls:
            out.append("the source is not encrypted")
        if self.source and self.source.startswith("custom:") and not self.trusted:
            out.append("custom sources must be trusted")
        return out

    def sink_depth(self) -> int:
        return max(self.sink_capacity, 1)


@dataclass(frozen=True)
class BatchConfig:
    """Limits of a shared batch stage; those that are None are not set."""

    size: int = 4
    latency_ns: int = 50_000_000
    in_flight: int = 1
    queue_capacity: int | None = None
    response_timeout_ns: int | None = None
    startup_timeout_ns: int | None = None

    def problems(self) -> list[str]:
        out = [f"{n} must be positive" for n in ("size", "latency_ns", "in_flight") if getattr(self, n) < 1]
        out += [f"{n} must be positive" for n in ("response_timeout_ns", "startup_timeout_ns") if getattr(self, n) is not None and getattr(self, n) < 1]
        if self.queue_capacity is not None and self.queue_capacity < self.size:
            out.append("queue_capacity must hold a whole batch")
        return out


def batch_problems(configs: DataFrame) -> Column:
    """BatchConfig.problems for rows with columns of the same names: an array of strings."""
    checks = [F.when(F.col(n) < 1, F.lit(f"{n} must be positive")) for n in ("size", "latency_ns", "in_flight", "response_timeout_ns", "startup_timeout_ns") if n in configs.columns]
    if "queue_capacity" in configs.columns:
        checks.append(F.when(F.col("queue_capacity") < F.col("size"), F.lit("queue_capacity must hold a whole batch")))
    return F.array_compact(F.array(*checks))


def declared_problems(stages: DataFrame) -> DataFrame:
    """Pipeline.problems for a table of declared stages (pipeline_id, stage_no, stage_id, consumes, produces; the last two
    arrays of names): one row per problem, with pipeline_id, stage_no, stage_id and problem.

    One window per pipeline gathers what the stages before produce; a pipeline has few stages.
    """
    order = Window.partitionBy("pipeline_id").orderBy("stage_no")
    have = F.flatten(F.collect_list("produces").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    nth = F.row_number().over(Window.partitionBy("pipeline_id", "stage_id").orderBy("stage_no"))
    rows = stages.select("pipeline_id", "stage_no", "stage_id", F.coalesce("consumes", F.array().cast("array<string>")).alias("consumes"), have.alias("have"), nth.alias("nth"))
    needs = F.transform(F.array_except("consumes", "have"), lambda c: F.concat(F.lit("needs "), c))
    found = F.concat(needs, F.array_compact(F.array(F.when(F.col("nth") > 1, F.lit("appears twice")))))
    return rows.select("pipeline_id", "stage_no", "stage_id", F.explode(found).alias("problem"))


def merged(outputs: DataFrame) -> DataFrame:
    """Stage outputs (feed_id, seq, stage_no, detections, tracks, signals, scene_features, artifacts) as one row per frame.

    Null detections or tracks leave the earlier ones; any non-null tracks make the frame authoritative. Signals and scene
    features add up in the order of the stages; an artifact replaces an earlier one of its kind.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("stage_no")))
    in_order = F.array_sort(F.collect_list(F.struct("stage_no", "signals", "scene_features", F.map_entries("artifacts").alias("entries"))))
    g = outputs.groupBy("feed_id", "seq").agg(last("detections").alias("detections"), last("tracks").alias("tracks"), (F.count("tracks") > 0).alias("authoritative"), in_order.alias("parts"))
    added = lambda c: F.flatten(F.filter(F.transform("parts", lambda p: p[c]), lambda v: v.isNotNull())).alias(c)
    entries = F.flatten(F.filter(F.transform("parts", lambda p: p["entries"]), lambda e: e.isNotNull()))
    kinds = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    newest = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return g.select("feed_id", "seq", "detections", "tracks", "authoritative", added("signals"), added("scene_features"), F.map_from_arrays(kinds, F.transform(kinds, newest)).alias("artifacts"))


def surviving(runs: DataFrame) -> DataFrame:
    """Stage runs (feed_id, seq, start_ns, stage_id, error) with those after a frame's first error left out."""
    first = runs.groupBy("feed_id", "seq").agg(F.min(F.when(F.col("error").isNotNull(), F.struct("start_ns", "stage_id"))).alias("stop"))
    rows = runs.join(first, ["feed_id", "seq"])
    return rows.filter(F.col("stop").isNull() | (F.struct("start_ns", "stage_id") <= F.col("stop"))).withColumn("frame_dropped", F.col("stop").isNotNull()).drop("stop")


def stop_reason(kind: Column) -> Column:
    """Why a feed stopped, from how its worker ended."""
    return (
        F.when(kind == "Shutdown", "UserRequested").when(kind == "Eos", "EndOfStream").when(kind.isin("StagePanic", "SourceFailure"), "RestartLimitExceeded").otherwise("Fatal")
    )
