"""Flow control as replays of arrival rows: bounded queues, micro-batches, coalesced health events, sampling, lag.

Each is a fold over one feed's (or processor's) rows in order of arrival; streams call the same step functions.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frameloom.operators.folds import fold_rows
from frameloom.operators.view import by_seq, so_far

# Depths, batch limits and thresholds of an unconfigured system.
QUEUE_DEPTH, BATCH_SIZE, BATCH_LATENCY_NS, THROTTLE_NS, LAG_NS = 4, 4, 50_000_000, 1_000_000_000, 2_000_000_000
RESPONSE_NS = 5_000_000_000
CHANNEL = 256


@dataclass
class Queue:
    """A bounded queue before one worker. ``policy``: DropOldest, DropNewest or Block."""

    depth: int = QUEUE_DEPTH
    policy: str = "DropOldest"
    free_at: int = 0
    waiting: deque = field(default_factory=deque)

    def _serve(self, now: int | None) -> list[tuple]:
        out = []
        while self.waiting and (now is None or max(self.free_at, self.waiting[0]["arrival_ns"]) <= now):
            row = self.waiting.popleft()
            begin = max(self.free_at, row["arrival_ns"])
            self.free_at = begin + row["service_ns"]
            out.append((row["feed_id"], row["seq"], False, begin - row["arrival_ns"], self.free_at))
        return out

    def push(self, row: dict) -> list[tuple]:
        """(feed_id, seq, dropped, hold_ns, done_ns) of what is settled by this row's arrival."""
        out = self._serve(row["arrival_ns"])
        if len(self.waiting) >= self.depth:
            if self.policy == "DropNewest":
                return [*out, (row["feed_id"], row["seq"], True, None, None)]
            if self.policy == "DropOldest":
                gone = self.waiting.popleft()
                out.append((gone["feed_id"], gone["seq"], True, None, None))
            else:
                out += self._serve(self.free_at)  # the producer waits for the worker's next turn
        self.waiting.append(row)
        return out + self._serve(row["arrival_ns"])

    def close(self) -> list[tuple]:
        return self._serve(None)


QUEUED = "feed_id long, seq long, dropped boolean, hold_ns long, done_ns long"


def queued(arrivals: DataFrame, depth: int = QUEUE_DEPTH, policy: str = "DropOldest") -> DataFrame:
    if depth < 1 or policy not in ("DropOldest", "DropNewest", "Block"):
        raise ValueError(f"no queue of depth {depth} with policy {policy}")
    return fold_rows(arrivals, ["feed_id"], ["arrival_ns", "seq"], lambda: Queue(depth, policy), lambda q, r: q.push(r), QUEUED, lambda q: q.close())


@dataclass
class Batcher:
    """A batch begins with its first item and closes when full or ``latency`` after it."""

    size: int
    latency: int
    batch: int = -1
    count: int = 0
    deadline: int = -1

    def add(self, row: dict) -> list[tuple]:
        if self.batch < 0 or self.count >= self.size or row["arrival_ns"] > self.deadline:
            self.batch, self.count, self.deadline = self.batch + 1, 0, row["arrival_ns"] + self.latency
        self.count += 1
        return [(row["feed_id"], row["seq"], self.batch, self.count)]


def batched(arrivals: DataFrame, size: int = BATCH_SIZE, latency_ns: int = BATCH_LATENCY_NS) -> DataFrame:
    """Rows with the batch they join and their place in it."""
    if size < 1 or latency_ns <= 0:
        raise ValueError("a batch needs a size and a latency")
    return fold_rows(arrivals, ["feed_id"], ["arrival_ns", "seq"], lambda: Batcher(size, latency_ns), lambda b, r: b.add(r), "feed_id long, seq long, batch_id long, place long")


@dataclass
class Coordinator:
    """One processor's submissions from all feeds: at most ``cap`` unanswered of a feed, and a shared first-in,
    first-out queue of ``capacity`` before a worker that gathers up to ``size`` items, or those within ``latency`` of
    the first, and answers them together when the slowest of them is done. An item that its feed no longer waits for
    stays in flight until then."""

    cap: int
    size: int
    latency: int
    capacity: int
    timeout: int
    free_at: int = 0
    gathered_at: int = 0
    deadline: int = 0
    waiting: deque = field(default_factory=deque)
    batch: list = field(default_factory=list)
    in_flight: dict = field(default_factory=dict)  # by feed: items without a time of answer
    answered: dict = field(default_factory=dict)  # by feed: times of answers to come

    def _work(self, now: int | None) -> list[tuple]:
        out = []
        while self.batch or self.waiting:
            if not self.batch:
                begin = max(self.free_at, self.waiting[0]["arrival_ns"])
                if now is not None and begin > now:
                    break
                self.gathered_at, self.deadline = begin, begin + self.latency
            while self.waiting and len(self.batch) < self.size:
                self.batch.append(self.waiting.popleft())
                self.gathered_at = max(self.gathered_at, self.batch[-1]["arrival_ns"])
            full = len(self.batch) >= self.size
            if not full and now is not None and self.deadline > now:
                break
            out += self._answer(self.gathered_at if full else self.deadline)
        return out

    def _answer(self, begin: int) -> list[tuple]:
        self.free_at = begin + max(r["service_ns"] for r in self.batch)
        out = []
        for r in self.batch:
            feed = r["feed_id"]
            self.in_flight[feed] -= 1
            self.answered.setdefault(feed, []).append(self.free_at)
            out.append((feed, r["seq"], "Timeout" if self.free_at - r["arrival_ns"] > self.timeout else "Accepted"))
        self.batch = []
        return out

    def submit(self, row: dict) -> list[tuple]:
        """(feed_id, seq, outcome) of what is settled by this row's arrival."""
        now, feed = row["arrival_ns"], row["feed_id"]
        out = self._work(now)
        self.answered[feed] = [d for d in self.answered.get(feed, ()) if d > now]
        if self.in_flight.get(feed, 0) + len(self.answered[feed]) >= self.cap:
            return [*out, (feed, row["seq"], "InFlightCapReached")]
        if len(self.waiting) >= self.capacity:
            return [*out, (feed, row["seq"], "QueueFull")]
        self.in_flight[feed] = self.in_flight.get(feed, 0) + 1
        self.waiting.append(row)
        return out + self._work(now)

    def close(self) -> list[tuple]:
        return self._work(None)


def submitted(arrivals: DataFrame, cap: int = 1, size: int = 1, latency_ns: int = BATCH_LATENCY_NS, capacity: int | None = None, response_ns: int = RESPONSE_NS) -> DataFrame:
    """Outcomes of the submissions to each processor (``processor_id``; without that column all go to one)."""
    if cap < 1:
        raise ValueError("at least one submission must be in flight")
    if size < 1 or latency_ns <= 0 or response_ns <= 0:
        raise ValueError("a batch needs a size, a latency and a time for its answer")
    capacity = max(4 * size, 4) if capacity is None else capacity
    if capacity < size:
        raise ValueError("the queue must hold a batch")
    rows = arrivals if "processor_id" in arrivals.columns else arrivals.withColumn("processor_id", F.lit(0))
    start = lambda: Coordinator(cap, size, latency_ns, capacity, latency_ns + response_ns)
    return fold_rows(rows, ["processor_id"], ["arrival_ns", "feed_id", "seq"], start, lambda s, r: s.submit(r), "feed_id long, seq long, outcome string", lambda s: s.close())


@dataclass
class Throttle:
    """Events of an overloaded stretch: one at its start, then at most one per ``every`` with what has gathered, and
    the rest at its end."""

    every: int = THROTTLE_NS
    on: bool = False
    gathered: int = 0
    last: int = 0
    at: tuple = ()

    def see(self, row: dict) -> list[tuple]:
        self.at = (row["feed_id"], row["ts_ns"])
        if not row["bad"]:
            out = [(*self.at, "recovered", self.gathered)] if self.on and self.gathered else []
            self.on, self.gathered = False, 0
            return out
        self.gathered += row["delta"]
        if self.on and row["ts_ns"] - self.last < self.every:
            return []
        kind = "ongoing" if self.on else "began"
        self.on, self.last, out = True, row["ts_ns"], [(*self.at, kind, self.gathered)]
        self.gathered = 0
        return out

    def stop(self) -> list[tuple]:
        return [(*self.at, "stopped", self.gathered)] if self.on and self.gathered else []


COALESCED = "feed_id long, ts_ns long, kind string, n long"


def coalesced(rows: DataFrame, every_ns: int = THROTTLE_NS) -> DataFrame:
    """Rows (feed_id, ts_ns, bad, delta) as few events whose numbers add up to all deltas of bad rows."""
    return fold_rows(rows, ["feed_id"], ["ts_ns", "event_id"], lambda: Throttle(every_ns), lambda s, r: s.see(r), COALESCED, lambda s: s.stop())


def output_lag(outputs: DataFrame, capacity: int = CHANNEL) -> DataFrame:
    """Rows (feed_id, seq, sent, drained) with what a ring of ``capacity`` has lost, and whether it began to lag."""
    behind = F.sum(F.col("sent") - F.col("drained")).over(so_far())
    rows = outputs.withColumn("lost", F.greatest(behind - capacity, F.lit(0).cast("long")))
    before = F.coalesce(F.lag("lost").over(by_seq()), F.lit(0))
    return rows.withColumn("transition", F.when((F.col("lost") > 0) & (before == 0), "began").when((F.col("lost") == 0) & (before > 0), "ended"))


def sampled(every: int) -> Column:
    """Whether a feed's completed frame is included: each ``every``-th; 0 is never, 1 always."""
    if every <= 0:
        return F.lit(False)
    return F.row_number().over(by_seq()) % every == 0


def source_fps(frames: DataFrame, n: int = 30) -> DataFrame:
    """Rate of each feed over its first ``n`` frames, by source time; null before ``n`` have come."""
    first = frames.withColumn("nth", F.row_number().over(by_seq())).filter(F.col("nth") <= n)
    span = (F.max("ts_ns") - F.min("ts_ns")) / 1e9
    fps = F.when((F.count("*") >= n) & (span > 0), (F.count("*") - 1) / span)
    return first.groupBy("feed_id").agg(fps.alias("fps"))


def interval_for(target: float, fps: Column) -> Column:
    """Frames per included frame that come closest to ``target`` a second; 0 is never."""
    if target <= 0:
        return F.lit(0).cast("long")
    return F.when((fps <= 0) | (target >= fps), 1).otherwise(F.greatest(F.floor(fps / target + 0.5), F.lit(1))).cast("long")


def to_target_fps(frames: DataFrame, target: float, fallback: int, n: int = 30) -> DataFrame:
    """Inclusion at a target rate: by ``fallback`` until the source's rate is known, by the fitted interval after."""
    rows = frames.withColumn("nth", F.row_number().over(by_seq())).join(source_fps(frames, n), "feed_id")
    k = interval_for(target, F.col("fps"))
    early = F.lit(False) if fallback <= 0 else F.col("nth") % fallback == 0
    late = F.when(k > 0, (F.col("nth") - n) % k == 0).otherwise(F.lit(False))
    return rows.withColumns({"interval": k, "included": F.when(F.col("nth") <= n, early).otherwise(late)})


@dataclass
class Smoothed:
    """Exponential mean of the momentary rate, begun with the first."""

    alpha: float
    last: int | None = None
    value: float = 0.0

    def see(self, row: dict) -> list[tuple]:
        if self.last is not None and row["ts_ns"] > self.last:
            now = 1e9 / (row["ts_ns"] - self.last)
            self.value = now if self.value == 0.0 else self.value + self.alpha * (now - self.value)
        self.last = row["ts_ns"]
        return [(row["feed_id"], row["seq"], self.value)]


def smoothed_fps(frames: DataFrame, alpha: float = 0.05) -> DataFrame:
    return fold_rows(frames.select("feed_id", "seq", "ts_ns"), ["feed_id"], ["seq"], lambda: Smoothed(alpha), lambda s, r: s.see(r), "feed_id long, seq long, fps double")


@dataclass
class Source:
    """A source's state by its events."""

    max_attempts: int = 0
    state: str = "Idle"
    attempts: int = 0

    def see(self, row: dict) -> list[tuple]:
        kind = row["kind"]
        if self.state != "Stopped":
            if kind == "StreamStarted":
                self.state, self.attempts = "Running", 0
            elif kind in ("Error", "Timeout", "Eos"):
                more = self.max_attempts == 0 or self.attempts < self.max_attempts
                self.state = "Reconnecting" if more and not (kind == "Eos" and not row["loops"]) else "Stopped"
                self.attempts += self.state == "Reconnecting"
            elif kind == "Pause" and self.state == "Running":
                self.state = "Paused"
            elif kind == "Resume" and self.state == "Paused":
                self.state = "Running"
        return [(row["feed_id"], row["ts_ns"], row["event_id"], kind, self.state, self.attempts)]


def source_states(events: DataFrame, max_attempts: int = 0) -> DataFrame:
    return fold_rows(events, ["feed_id"], ["ts_ns", "event_id"], lambda: Source(max_attempts), lambda s, r: s.see(r), "feed_id long, ts_ns long, event_id long, kind string, state string, attempts long")


@dataclass
class Restarts:
    """Whether a feed's worker may start again after an exit; a long enough run forgives what came before."""

    policy: str = "SourceOrStage"
    limit: int = 5
    window_ns: int = 300_000_000_000
    count: int = 0

    def see(self, row: dict) -> list[tuple]:
        never = self.policy == "Never" or self.limit == 0 or (self.policy == "SourceFailure" and row["fault"] == "Stage")
        ok = False
        if not never:
            if row["uptime_ns"] >= self.window_ns:
                self.count, ok = 1, True
            elif self.count < self.limit:
                self.count, ok = self.count + 1, True
        return [(row["feed_id"], row["seq"], ok, self.count)]


def restarts(exits: DataFrame, policy: str = "SourceOrStage", limit: int = 5) -> DataFrame:
    return fold_rows(exits, ["feed_id"], ["seq"], lambda: Restarts(policy, limit), lambda s, r: s.see(r), "feed_id long, seq long, restarted boolean, restarts long")
