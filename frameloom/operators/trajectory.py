"""Trajectories: segments of a track's points by view epoch, motion features, bounded histories.

Input rows: feed_id, track_id, seq, ts_ns, x, y, state, epoch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from frameloom.functions.geometry import affine_point, affine_then
from frameloom.operators.folds import fold_rows

TRACK = ("feed_id", "track_id")
SEGMENT = (*TRACK, "segment")
STATIONARY, STILL = 0.005, 1e-6  # speed and net displacement below which a segment stands still or has no direction
MAX_OBSERVATIONS, MAX_POINTS = 100, 1000


def by_track() -> WindowSpec:
    return Window.partitionBy(*TRACK).orderBy("seq")


def so_far() -> WindowSpec:
    return by_track().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before() -> WindowSpec:
    return by_track().rowsBetween(Window.unboundedPreceding, -1)


def segmented(points: DataFrame) -> DataFrame:
    """Points with their segment: one begins with the track and at each change of epoch; after the first Lost, whose
    point still counts, a track gets no more points."""
    lost = F.max((F.col("state") == "Lost").cast("int")).over(before())
    rows = points.withColumn("gone", F.coalesce(lost, F.lit(0))).filter("gone = 0").drop("gone")
    fresh = F.coalesce(F.col("epoch") != F.lag("epoch").over(by_track()), F.lit(True))
    return rows.withColumn("fresh", fresh.cast("long")).withColumn("segment", F.sum("fresh").over(so_far())).drop("fresh")


def bounds(rows: DataFrame) -> DataFrame:
    """One row per segment with its epoch and what opened and closed it."""
    last = F.max_by("state", "seq")
    segs = rows.groupBy(*SEGMENT).agg(F.min("epoch").alias("epoch"), last.alias("last_state"))
    by_segment = Window.partitionBy(*TRACK).orderBy("segment")
    previous, after = F.lag("epoch").over(by_segment), F.lead("epoch").over(by_segment)
    change = lambda a, b: F.concat(F.lit("EpochChange:"), a.cast("string"), F.lit(">"), b.cast("string"))
    return segs.select(
        *SEGMENT,
        "epoch",
        F.coalesce(change(previous, F.col("epoch")), F.lit("TrackCreated")).alias("opened_by"),
        F.coalesce(change(F.col("epoch"), after), F.when(F.col("last_state") == "Lost", "TrackLost")).alias("closed_by"),
    )


def stepped(rows: DataFrame) -> DataFrame:
    """Points with the distance and time from the segment's point before."""
    w = Window.partitionBy(*SEGMENT).orderBy("seq")
    dx, dy = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    return rows.withColumn("step", F.sqrt(dx * dx + dy * dy)).withColumn("dt", (F.col("ts_ns") - F.lag("ts_ns").over(w)) / 1e9)


def features(path: Column, net: Column, elapsed: Column, fastest: Column, n: Column, dx: Column, dy: Column) -> dict[str, Column]:
    mean = F.when(elapsed > 0, path / elapsed).otherwise(F.lit(0.0))
    some = n >= 2
    return {
        "displacement": F.when(some, path).otherwise(0.0),
        "net_displacement": F.when(some, net).otherwise(0.0),
        "mean_speed": F.when(some, mean).otherwise(0.0),
        "max_speed": F.when(some, F.coalesce(fastest, F.lit(0.0))).otherwise(0.0),
        "direction": F.when(some & (net > STILL), F.atan2(dy, dx)),
        "is_stationary": ~some | (mean < STATIONARY),
    }


def motion(rows: DataFrame) -> DataFrame:
    """Motion features of each whole segment, from one aggregation."""
    ends = {f"{c}{k}": f(c, "seq") for c in ("x", "y", "ts_ns") for k, f in ((0, F.min_by), (1, F.max_by))}
    speed = F.when(F.col("dt") > 0, F.col("step") / F.col("dt"))
    aggs = [c.alias(n) for n, c in ends.items()]
    g = stepped(rows).groupBy(*SEGMENT).agg(F.count("*").alias("n"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"), F.max(speed).alias("fastest"), *aggs)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return g.select(*SEGMENT, "n", *[c.alias(k) for k, c in features(F.col("path"), F.sqrt(dx * dx + dy * dy), (F.col("ts_ns1") - F.col("ts_ns0")) / 1e9, F.col("fastest"), F.col("n"), dx, dy).items()])


def running_motion(rows: DataFrame) -> DataFrame:
    """Motion features after each point, from running windows."""
    w = Window.partitionBy(*SEGMENT).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    speed = F.when(F.col("dt") > 0, F.col("step") / F.col("dt"))
    dx, dy = F.col("x") - F.first("x").over(w), F.col("y") - F.first("y").over(w)
    out = features(F.coalesce(F.sum("step").over(w), F.lit(0.0)), F.sqrt(dx * dx + dy * dy), (F.col("ts_ns") - F.first("ts_ns").over(w)) / 1e9, F.max(speed).over(w), F.count("*").over(w), dx, dy)
    return stepped(rows).withColumns(out)


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each track."""
    back = F.row_number().over(Window.partitionBy(*TRACK).orderBy(F.desc("seq")))
    return rows.withColumn("back", back).filter(F.col("back") <= n).drop("back")


def closed_by_restart(points: DataFrame, session: Column) -> DataFrame:
    """Segments that a feed's restart closes: of each session but a feed's last, each track's last segment, unless
    Lost has closed it. Histories of different sessions never meet."""
    rows = points.withColumn("feed_id", F.struct("feed_id", session.alias("session")))
    g = segmented(rows).groupBy(*TRACK).agg(F.max("segment").alias("segment"), F.max_by("state", "seq").alias("last_state"))
    g = g.select("feed_id.feed_id", "feed_id.session", "track_id", "segment", "last_state")
    last = F.max("session").over(Window.partitionBy("feed_id"))
    g = g.withColumn("last", last).filter("session < last AND last_state <> 'Lost'")
    return g.select("feed_id", "session", "track_id", "segment", F.lit("FeedRestart").alias("closed_by"))


AFFINE = ("a", "b", "tx", "c", "d", "ty")
UNMOVED = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)


@dataclass
class Chain:
    """What a feed's compensations have come to, one applied after the other."""

    n: int = 0
    m: tuple = UNMOVED

    def add(self, row: dict) -> list[tuple]:
        a, b, tx, c, d, ty = (row[k] for k in AFFINE)
        p, q, u, r, s, v = self.m
        self.n, self.m = self.n + 1, (a * p + b * r, a * q + b * s, a * u + b * v + tx, c * p + d * r, c * q + d * s, c * u + d * v + ty)
        return [(row["feed_id"], row["seq"], self.n, list(self.m))]


def _since(rows: DataFrame, shifts: DataFrame) -> DataFrame:
    """``rows`` with the transform (AFFINE) and number of the compensations after their own frame, up to the last frame
    of their segment.

    With C the product of a feed's compensations up to a frame, that is C at the segment's end times the inverse of C at
    the row's own frame. Only the few compensations are folded in order; the rows meet them in windows. Compensations
    are invertible, as camera motions are.
    """
    chain = fold_rows(shifts.select("feed_id", "seq", *AFFINE), ["feed_id"], ["seq"], Chain, lambda s, r: s.add(r), "feed_id long, seq long, n long, m array<double>")
    marks = chain.select("feed_id", "seq", F.struct("n", "m").alias("chain"), F.lit(0).alias("kind"))
    both = rows.withColumn("kind", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy("feed_id").orderBy("seq", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    none = F.struct(F.lit(0).cast("long").alias("n"), F.array(*map(F.lit, UNMOVED)).alias("m"))
    both = both.withColumn("chain", F.coalesce(F.last("chain", ignorenulls=True).over(w), none)).filter("kind = 1")
    both = both.withColumn("end", F.max_by("chain", "seq").over(Window.partitionBy(*SEGMENT)))
    p, q, u, r, s, v = (F.col("chain.m")[k] for k in range(6))
    det = p * s - q * r
    back = [s / det, -q / det, (q * v - s * u) / det, -r / det, p / det, (r * u - p * v) / det]
    since = affine_then(back, [F.col("end.m")[k] for k in range(6)])
    return both.withColumns({k: m for k, m in zip(AFFINE, since, strict=True)} | {"n_compensations": F.col("end.n") - F.col("chain.n")}).drop("chain", "end", "kind")


def compensated(rows: DataFrame, shifts: DataFrame) -> DataFrame:
    """Points moved by the compensations (feed_id, seq, AFFINE) of later frames within their segment's lifetime. The
    compensation of a frame comes before that frame's point."""
    found = _since(rows.select(*SEGMENT, "seq", "x", "y"), shifts)
    x, y = affine_point([F.col(k) for k in AFFINE], F.col("x"), F.col("y"))
    return found.select(*SEGMENT, "seq", x.alias("x"), y.alias("y"), "n_compensations")


def segment_transforms(rows: DataFrame, shifts: DataFrame) -> DataFrame:
    """One row per segment: the compensations it has got, as one transform (AFFINE), and their number."""
    found = _since(rows.select(*SEGMENT, "seq"), shifts)
    first = lambda c, n: F.min_by(c, "seq").alias(n)
    return found.groupBy(*SEGMENT).agg(first("n_compensations", "n"), *[first(k, k) for k in AFFINE])
