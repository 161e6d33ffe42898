"""The temporal store: bounded per-feed track histories with admission, eviction, retention and ends.

``TrackStore`` is the plain fold of one feed; ``commits`` replays observation rows through it and ``retained`` tells
what is left at the end. Where a feed never holds more tracks than the cap, ``window_retained`` gives the same from
windows alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frameloom.operators.folds import fold_rows

# Which states may be evicted, first to last.
EVICTION_ORDER = ("Lost", "Coasted", "Tentative")


@dataclass(frozen=True)
class Retention:
    max_tracks: int = 500
    max_observations: int = 100
    max_points: int = 1000
    lost_age_ns: int = 30_000_000_000


@dataclass
class History:
    first_seen: int
    last_seen: int
    state: str
    epoch: int
    observations: list = field(default_factory=list)
    points: int = 0
    segments: int = 0
    open: bool = False


class TrackStore:
    def __init__(self, retention: Retention | None = None):
        self.retention = retention or Retention()
        self.tracks: dict[int, History] = {}

    def victim(self) -> int | None:
        """The track to evict: by state, then least recently seen, then least id; confirmed tracks never are."""
        free = [(EVICTION_ORDER.index(h.state), h.last_seen, k) for k, h in self.tracks.items() if h.state in EVICTION_ORDER]
        return min(free)[2] if free else None

    def commit(self, track_id: int, ts: int, state: str, epoch: int, observation) -> tuple[bool, int | None]:
        """Whether the track was admitted, and the track evicted for it. Updates of known tracks always are."""
        evicted, h = None, self.tracks.get(track_id)
        if h is None:
            if len(self.tracks) >= self.retention.max_tracks:
                evicted = self.victim()
                if evicted is None:
                    return False, None
                del self.tracks[evicted]
            h = self.tracks[track_id] = History(ts, ts, state, epoch, segments=1, open=True)
        elif h.open and epoch != h.epoch:
            h.segments += 1
        h.last_seen, h.state = ts, state
        h.observations = [*h.observations, observation][-self.retention.max_observations :]
        if h.open:
            h.epoch, h.points = epoch, min(h.points + 1, self.retention.max_points)
            h.open = state != "Lost"
        return True, evicted

    def retain(self, ts: int) -> list[int]:
        """Drop tracks lost for too long, then those beyond the cap; returns the dropped."""
        old = [k for k, h in self.tracks.items() if h.state == "Lost" and ts - h.last_seen >= self.retention.lost_age_ns]
        for k in old:
            del self.tracks[k]
        while len(self.tracks) > self.retention.max_tracks and (k := self.victim()) is not None:
            del self.tracks[k]
            old.append(k)
        return old

    def end_absent(self, present: set[int]) -> list[int]:
        """End the tracks that an authoritative frame does not hold; they free their places before its commits."""
        gone = [k for k in self.tracks if k not in present]
        for k in gone:
            del self.tracks[k]
        return gone


COMMITS = "feed_id long, seq long, track_id long, admitted boolean, evicted long, n_tracks long, n_observations long, n_points long, n_segments long, first_seen long"


def commit_row(store: TrackStore, r: dict) -> list[tuple]:
    ok, evicted = store.commit(r["track_id"], r["ts_ns"], r["state"], r["epoch"], r["det_id"])
    h = store.tracks.get(r["track_id"])
    store.retain(r["ts_ns"])
    counts = (len(h.observations), h.points, h.segments, h.first_seen) if h else (None,) * 4
    return [(r["feed_id"], r["seq"], r["track_id"], ok, evicted, len(store.tracks), *counts)]


def commits(points: DataFrame, retention: Retention | None = None) -> DataFrame:
    """What each observation's commit did, and the store's size after the frame's retention."""
    return fold_rows(points, ["feed_id"], ["seq"], lambda: TrackStore(retention), commit_row, COMMITS)


@dataclass
class Held:
    """A fold over a feed's rows that gives what its store holds at the end."""

    store: TrackStore
    feed: int | None = None

    def step(self, row: dict) -> list[tuple]:
        self.feed = row["feed_id"]
        commit_row(self.store, row)
        return []

    def close(self) -> list[tuple]:
        return [(self.feed, k, len(h.observations), h.points) for k, h in self.store.tracks.items()]


def retained(points: DataFrame, retention: Retention | None = None) -> DataFrame:
    """Each track's latest row, whether the store holds it at its feed's end, and how much of it; by all rules: age of
    lost tracks, cap with eviction and rejection, and pruning."""
    ddl = "feed_id long, track_id long, n_observations long, n_points long"
    held = fold_rows(points, ["feed_id"], ["seq", "track_id"], lambda: Held(TrackStore(retention)), lambda s, r: s.step(r), ddl, lambda s: s.close())
    rows = window_retained(points, retention).drop("kept").join(held, ["feed_id", "track_id"], "left")
    return rows.withColumn("kept", F.col("n_points").isNotNull())


def window_retained(points: DataFrame, retention: Retention | None = None) -> DataFrame:
    """Each track's latest row and whether retention keeps it at its feed's end; needs no more tracks than the cap."""
    r = retention or Retention()
    end = F.max("ts_ns").over(Window.partitionBy("feed_id"))
    last = F.row_number().over(Window.partitionBy("feed_id", "track_id").orderBy(F.desc("seq")))
    rows = points.withColumns({"end_ns": end, "back": last}).filter("back = 1")
    return rows.withColumn("kept", (F.col("state") != "Lost") | (F.col("end_ns") - F.col("ts_ns") < r.lost_age_ns)).drop("back")


def looked_up(points: DataFrame, ids: DataFrame) -> DataFrame:
    """What a store knows of each asked id (feed_id, track_id): has_track, latest state and epoch, epoch and time of
    creation, number of points."""
    of_latest = [F.max_by(c, "seq").alias(c) for c in ("state", "epoch")]
    first = F.min_by("epoch", "seq").alias("created_epoch")
    known = points.groupBy("feed_id", "track_id").agg(*of_latest, first, F.min("ts_ns").alias("first_seen"), F.count("*").alias("n_points"))
    found = ids.join(known, ["feed_id", "track_id"], "left")
    return found.withColumn("has_track", F.col("n_points").isNotNull()).withColumn("n_points", F.coalesce("n_points", F.lit(0).cast("long")))


def eviction_order(rows: DataFrame) -> DataFrame:
    """Candidates of each feed in the order of eviction."""
    rank = F.array_position(F.array(*map(F.lit, EVICTION_ORDER)), F.col("state"))
    place = F.row_number().over(Window.partitionBy("feed_id").orderBy(rank, "ts_ns", "track_id"))
    return rows.filter(F.col("state").isin(*EVICTION_ORDER)).withColumn("place", place.cast("long"))
