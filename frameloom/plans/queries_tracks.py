"""Queries of tracks: trajectories, the temporal store and the tracker."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.functions.geometry import Box
from frameloom.operators import store, tracker
from frameloom.operators import trajectory as tj
from frameloom.plans.queries_scalar import r6
from frameloom.registry import query

POINTS = """k AS (SELECT *, coalesce(max(CASE WHEN state = 'Lost' THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM track_points),
e AS (SELECT *, lag(epoch) OVER (PARTITION BY feed_id, track_id ORDER BY seq) AS e0 FROM k WHERE gone = 0),
g AS (SELECT *, cast(sum(CASE WHEN e0 IS NULL OR e0 <> epoch THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, track_id ORDER BY seq) AS bigint) AS segment FROM e),
st AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS step, (ts_ns - lag(ts_ns) OVER w) / 1e9 AS dt FROM g WINDOW w AS (PARTITION BY feed_id, track_id, segment ORDER BY seq))"""
SEG = "feed_id, track_id, segment"


@query("win_segment_id", f"WITH {POINTS} SELECT {SEG}, seq FROM g")
def win_segment_id(t):
    return tj.segmented(t.track_points).select(*tj.SEGMENT, "seq")


@query("win_seg_bounds", f"""WITH {POINTS}, b AS (SELECT {SEG}, min(epoch) AS epoch, arg_max(state, seq) AS last_state FROM g GROUP BY ALL),
c AS (SELECT *, lag(epoch) OVER w AS before, lead(epoch) OVER w AS after FROM b WINDOW w AS (PARTITION BY feed_id, track_id ORDER BY segment))
SELECT {SEG}, epoch, CASE WHEN before IS NULL THEN 'TrackCreated' ELSE 'EpochChange:' || before || '>' || epoch END AS opened_by,
CASE WHEN after IS NOT NULL THEN 'EpochChange:' || epoch || '>' || after WHEN last_state = 'Lost' THEN 'TrackLost' END AS closed_by FROM c""")
def win_seg_bounds(t):
    return tj.bounds(tj.segmented(t.track_points))


@query("agg_motion", f"""WITH {POINTS}, a AS (SELECT {SEG}, count(*) AS n, coalesce(sum(step), 0e0) AS path, max(CASE WHEN dt > 0 THEN step / dt END) AS fastest,
arg_max(x, seq) - arg_min(x, seq) AS dx, arg_max(y, seq) - arg_min(y, seq) AS dy, (max(ts_ns) - min(ts_ns)) / 1e9 AS el FROM st GROUP BY ALL),
m AS (SELECT *, sqrt(dx * dx + dy * dy) AS net, CASE WHEN el > 0 THEN path / el ELSE 0e0 END AS mean FROM a)
SELECT {SEG}, n, round(path, 6) AS displacement, round(net, 6) AS net_displacement, round(mean, 6) AS mean_speed, round(coalesce(fastest, 0e0), 6) AS max_speed,
round(CASE WHEN n >= 2 AND net > 1e-6 THEN atan2(dy, dx) END, 6) AS direction, n < 2 OR mean < 0.005e0 AS is_stationary FROM m""")
def agg_motion(t):
    m = tj.motion(tj.segmented(t.track_points))
    return m.select(*tj.SEGMENT, "n", *[r6(F.col(c), c) for c in ("displacement", "net_displacement", "mean_speed", "max_speed", "direction")], "is_stationary")


@query("agg_motion_inc", f"""WITH {POINTS}, a AS (SELECT {SEG}, seq, coalesce(sum(step) OVER w, 0e0) AS path, max(CASE WHEN dt > 0 THEN step / dt END) OVER w AS fastest, x - first_value(x) OVER w AS dx, y - first_value(y) OVER w AS dy FROM st
WINDOW w AS (PARTITION BY feed_id, track_id, segment ORDER BY seq)) SELECT {SEG}, seq, round(path, 6) AS displacement, round(sqrt(dx * dx + dy * dy), 6) AS net_displacement, round(coalesce(fastest, 0e0), 6) AS max_speed FROM a""")
def agg_motion_inc(t):
    m = tj.running_motion(tj.segmented(t.track_points))
    return m.select(*tj.SEGMENT, "seq", *[r6(F.col(c), c) for c in ("displacement", "net_displacement", "max_speed")])


@query("agg_seg_duration", f"WITH {POINTS} SELECT {SEG}, CASE WHEN count(*) >= 2 THEN max(ts_ns) - min(ts_ns) END AS duration_ns FROM g GROUP BY ALL")
def agg_seg_duration(t):
    span = F.when(F.count("*") >= 2, F.max("ts_ns") - F.min("ts_ns"))
    return tj.segmented(t.track_points).groupBy(*tj.SEGMENT).agg(span.alias("duration_ns"))


@query("agg_traj_counts", f"WITH {POINTS} SELECT feed_id, count(*) AS total_points, count(DISTINCT (track_id, segment)) AS segment_count, count(DISTINCT track_id) AS track_count FROM g GROUP BY feed_id")
def agg_traj_counts(t):
    g = tj.segmented(t.track_points)
    return g.groupBy("feed_id").agg(F.count("*").alias("total_points"), F.countDistinct("track_id", "segment").alias("segment_count"), F.countDistinct("track_id").alias("track_count"))


SHIFTS = """sh AS (SELECT feed_id, seq, {a: 1 + cast(k % 7 AS double) / 1000, b: cast(k % 5 AS double) / -1000, tx: cast(k % 40 AS double) / 1000,
  c: cast(k % 5 AS double) / 1000, d: 1 - cast(k % 3 AS double) / 1000, ty: cast(k % 30 AS double) / 1000} AS m FROM reports WHERE k % 9 = 0)"""
# p, then q, of a list of transforms
COMPOSED = """list_reduce(list_prepend({a: 1e0, b: 0e0, tx: 0e0, c: 0e0, d: 1e0, ty: 0e0}, coalesce(list(m ORDER BY sh.seq) FILTER (m IS NOT NULL), [])), lambda p, q:
  {a: q.a * p.a + q.b * p.c, b: q.a * p.b + q.b * p.d, tx: q.a * p.tx + q.b * p.ty + q.tx, c: q.c * p.a + q.d * p.c, d: q.c * p.b + q.d * p.d, ty: q.c * p.tx + q.d * p.ty + q.ty})"""


def shifts(t):
    k = F.col("k")
    m = {"a": 1 + k % 7 / 1000, "b": k % 5 / -1000, "tx": k % 40 / 1000, "c": k % 5 / 1000, "d": 1 - k % 3 / 1000, "ty": k % 30 / 1000}
    return t.reports.filter("k % 9 = 0").select("feed_id", "seq", *[c.alias(n) for n, c in m.items()])


@query("view_compensate", f"""WITH {POINTS}, {SHIFTS}, l AS (SELECT {SEG}, max(seq) AS last_seq FROM g GROUP BY ALL),
z AS (SELECT g.feed_id, g.track_id, g.segment, g.seq, any_value(g.x) AS x, any_value(g.y) AS y, {COMPOSED} AS t, count(m) AS n_compensations
FROM g JOIN l USING ({SEG}) LEFT JOIN sh ON sh.feed_id = g.feed_id AND sh.seq > g.seq AND sh.seq <= l.last_seq GROUP BY ALL)
SELECT {SEG}, seq, round(t.a * x + t.b * y + t.tx, 6) AS x, round(t.c * x + t.d * y + t.ty, 6) AS y, n_compensations FROM z""")
def view_compensate(t):
    m = tj.compensated(tj.segmented(t.track_points), shifts(t))
    return m.select(*tj.SEGMENT, "seq", r6(F.col("x"), "x"), r6(F.col("y"), "y"), "n_compensations")


@query("agg_affine_cum", f"""WITH {POINTS}, {SHIFTS}, l AS (SELECT {SEG}, min(seq) AS s0, max(seq) AS s1 FROM g GROUP BY ALL),
z AS (SELECT l.feed_id, l.track_id, l.segment, count(m) AS n, {COMPOSED} AS t FROM l LEFT JOIN sh ON sh.feed_id = l.feed_id AND sh.seq > s0 AND sh.seq <= s1 GROUP BY ALL)
SELECT {SEG}, n, {", ".join(f"round(t.{k}, 6) AS {k}" for k in tj.AFFINE)} FROM z""")
def agg_affine_cum(t):
    m = tj.segment_transforms(tj.segmented(t.track_points), shifts(t))
    return m.select(*tj.SEGMENT, "n", *[r6(F.col(k), k) for k in tj.AFFINE])


@query("win_ring", "SELECT feed_id, track_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, track_id ORDER BY seq DESC) AS b FROM track_points) WHERE b <= 50")
def win_ring(t):
    return tj.newest(t.track_points, 50).select("feed_id", "track_id", "seq")


@query("win_prune_points", f"WITH {POINTS} SELECT {SEG}, count(*) AS n_points, min(seq) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, track_id ORDER BY seq DESC) AS b FROM g) WHERE b <= 20 GROUP BY ALL")
def win_prune_points(t):
    return tj.newest(tj.segmented(t.track_points), 20).groupBy(*tj.SEGMENT).agg(F.count("*").alias("n_points"), F.min("seq").alias("oldest"))


@query("win_first_last_seen", "SELECT feed_id, track_id, min(ts_ns) AS first_seen, max(ts_ns) AS last_seen, arg_min(epoch, seq) AS epoch_at_creation FROM track_points GROUP BY ALL")
def win_first_last_seen(t):
    return t.track_points.groupBy("feed_id", "track_id").agg(F.min("ts_ns").alias("first_seen"), F.max("ts_ns").alias("last_seen"), F.min_by("epoch", "seq").alias("epoch_at_creation"))


LATEST = "l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, track_id ORDER BY seq DESC) AS b, max(ts_ns) OVER (PARTITION BY feed_id) AS end_ns FROM track_points) WHERE b = 1)"
ORDERED = f"WITH {LATEST}, o AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY CASE state WHEN 'Lost' THEN 1 WHEN 'Coasted' THEN 2 ELSE 3 END, ts_ns, track_id) AS place, count(*) OVER (PARTITION BY feed_id) AS c FROM l WHERE state <> 'Confirmed')"


@query("top_evict_one", f"{ORDERED} SELECT feed_id, track_id, state FROM o WHERE place = 1")
def top_evict_one(t):
    return store.eviction_order(store.window_retained(t.track_points)).filter("place = 1").select("feed_id", "track_id", "state")


@query("top_evict_cap", f"{ORDERED} SELECT feed_id, track_id, place FROM o WHERE place <= (SELECT count(*) FROM l WHERE l.feed_id = o.feed_id) - 18")
def top_evict_cap(t):
    rows = store.window_retained(t.track_points)
    n = F.count("*").over(Window.partitionBy("feed_id"))
    return store.eviction_order(rows.withColumn("n", n)).filter("place <= n - 18").select("feed_id", "track_id", "place")


@query("st_retention", f"WITH {LATEST} SELECT feed_id, track_id, state <> 'Lost' OR end_ns - ts_ns < 30000000000 AS kept FROM l")
def st_retention(t):
    return store.retained(t.track_points).select("feed_id", "track_id", "kept")


# one commit a step; ``w`` holds the feed's tracks, at most twelve
COMMITS = """WITH RECURSIVE l AS (SELECT feed_id, list({'seq': seq, 'id': track_id, 't': ts_ns, 'state': state, 'epoch': epoch} ORDER BY seq) AS es FROM track_points GROUP BY feed_id),
r(feed_id, k, w, seq, track_id, admitted, evicted) AS (SELECT feed_id, cast(0 AS bigint), [{'id': cast(0 AS bigint), 'first': cast(0 AS bigint), 'last': cast(0 AS bigint), 'state': '', 'epoch': cast(0 AS bigint), 'seen': cast(0 AS bigint), 'points': cast(0 AS bigint), 'segments': cast(0 AS bigint), 'lit': false}][1:0], cast(0 AS bigint), cast(0 AS bigint), false, cast(NULL AS bigint) FROM l UNION ALL
 SELECT feed_id, k + 1, CASE WHEN h IS NULL AND len(w) >= 12 AND v IS NULL THEN aged ELSE list_append(list_filter(aged, lambda x: x.id <> e.id AND (h IS NOT NULL OR len(w) < 12 OR x.id <> v)),
   {'id': e.id, 'first': coalesce(h.first, e.t), 'last': e.t, 'state': e.state, 'epoch': CASE WHEN h IS NULL OR h.lit THEN e.epoch ELSE h.epoch END, 'seen': least(coalesce(h.seen, 0) + 1, 100), 'points': CASE WHEN h IS NULL THEN 1 WHEN h.lit THEN least(h.points + 1, 1000) ELSE h.points END,
    'segments': CASE WHEN h IS NULL THEN 1 WHEN h.lit AND h.epoch <> e.epoch THEN h.segments + 1 ELSE h.segments END, 'lit': coalesce(h.lit, true) AND e.state <> 'Lost'}) END,
  e.seq, e.id, h IS NOT NULL OR len(w) < 12 OR v IS NOT NULL, CASE WHEN h IS NULL AND len(w) >= 12 THEN v END
 FROM (SELECT r.feed_id, k, w, es[k + 1] AS e, list_filter(w, lambda x: x.id = es[k + 1].id)[1] AS h, list_filter(w, lambda x: x.state <> 'Lost' OR es[k + 1].t - x.last < 30000000000) AS aged,
   list_sort(list_transform(list_filter(w, lambda x: x.state <> 'Confirmed'), lambda x: {'o': CASE x.state WHEN 'Lost' THEN 0 WHEN 'Coasted' THEN 1 ELSE 2 END, 'l': x.last, 'id': x.id}))[1].id AS v FROM r JOIN l ON r.feed_id = l.feed_id AND k < len(es)) AS s),
c AS (SELECT feed_id, seq, track_id, admitted, evicted, cast(len(w) AS bigint) AS n_tracks, CASE WHEN admitted THEN w[-1].seen END AS n_observations, CASE WHEN admitted THEN w[-1].points END AS n_points, CASE WHEN admitted THEN w[-1].segments END AS n_segments, CASE WHEN admitted THEN w[-1].first END AS first_seen FROM r WHERE k > 0)
"""


@query("st_commit", f"{COMMITS} SELECT * FROM c")
def st_commit(t):
    return store.commits(t.track_points, store.Retention(max_tracks=12))


@query("st_admit", f"{COMMITS} SELECT feed_id, count(*) FILTER (admitted) AS admitted, count(*) FILTER (NOT admitted) AS rejected, count(evicted) AS evicted FROM c GROUP BY feed_id")
def st_admit(t):
    done = store.commits(t.track_points, store.Retention(max_tracks=12))
    return done.groupBy("feed_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"), F.count("evicted").alias("evicted"))


@query("st_clear", "SELECT feed_id, CASE WHEN seq >= 1000 THEN 1 ELSE 0 END AS session, count(*) AS n, count(DISTINCT track_id) AS tracks FROM track_points GROUP BY ALL")
def st_clear(t):
    session = F.when(F.col("seq") >= 1000, 1).otherwise(0)  # a restart: histories of different sessions never meet
    return t.track_points.groupBy("feed_id", session.alias("session")).agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"))


@query("st_snapshot", "SELECT feed_id, seq, track_id, count(*) OVER w AS seen, max(ts_ns) OVER w AS last_seen FROM track_points WINDOW w AS (PARTITION BY feed_id, track_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def st_snapshot(t):
    return t.track_points.select("feed_id", "seq", "track_id", F.count("*").over(tj.before()).alias("seen"), F.max("ts_ns").over(tj.before()).alias("last_seen"))


@query("st_lookup", f"WITH {POINTS} SELECT feed_id, track_id, count(*) AS trajectory_points, max(segment) AS segments, max(ts_ns) AS last_seen FROM g GROUP BY ALL")
def st_lookup(t):
    return tj.segmented(t.track_points).groupBy("feed_id", "track_id").agg(F.count("*").alias("trajectory_points"), F.max("segment").alias("segments"), F.max("ts_ns").alias("last_seen"))


@query("st_trackstore", f"""WITH {LATEST}, a AS (SELECT DISTINCT feed_id, track_id + more AS track_id FROM track_points, (VALUES (0), (100)) AS v(more)),
c AS (SELECT feed_id, track_id, count(*) AS n_points, min(ts_ns) AS first_seen, arg_min(epoch, seq) AS created_epoch FROM track_points GROUP BY ALL)
SELECT a.feed_id, a.track_id, l.track_id IS NOT NULL AS has_track, l.state, l.epoch, created_epoch, first_seen, coalesce(n_points, 0) AS n_points
FROM a LEFT JOIN l ON l.feed_id = a.feed_id AND l.track_id = a.track_id LEFT JOIN c ON c.feed_id = a.feed_id AND c.track_id = a.track_id""")
def st_trackstore(t):
    # every track, and as many ids that no track has
    ids = t.track_points.select("feed_id", F.explode(F.array(F.col("track_id"), F.col("track_id") + 100)).alias("track_id")).distinct()
    return store.looked_up(t.track_points, ids)


ENDS = "WITH f AS (SELECT DISTINCT feed_id, cast((seq - seq % 8) / 8 AS bigint) AS frame, track_id FROM track_points)"


def frames8(t):
    return t.track_points.select("feed_id", F.floor((F.col("seq") - F.col("seq") % 8) / 8).alias("frame"), "track_id").distinct()


@query("anti_track_end", ENDS + " SELECT feed_id, frame + 1 AS frame, track_id FROM f p WHERE NOT EXISTS (FROM f WHERE f.feed_id = p.feed_id AND f.frame = p.frame + 1 AND f.track_id = p.track_id)")
def anti_track_end(t):
    f = frames8(t)
    before = f.withColumn("frame", F.col("frame") + 1)
    return before.join(f, ["feed_id", "frame", "track_id"], "left_anti")


@query("st_end", ENDS + ", n AS (SELECT *, lead(frame) OVER (PARTITION BY feed_id, track_id ORDER BY frame) AS next FROM f) SELECT feed_id, track_id, frame + 1 AS ended_at, 'TrackEnded' AS closed_by FROM n WHERE next IS NULL OR next > frame + 1")
def st_end(t):
    after = F.lead("frame").over(Window.partitionBy("feed_id", "track_id").orderBy("frame"))
    gone = frames8(t).withColumn("after", after).filter("after IS NULL OR after > frame + 1")
    return gone.select("feed_id", "track_id", (F.col("frame") + 1).alias("ended_at"), F.lit("TrackEnded").alias("closed_by"))


def box_frames(t):
    """Every frame of the feeds of moving_boxes, also those without a box."""
    return t.observations.select("feed_id", F.floor(F.col("seq") / 4).alias("seq")).distinct()


@query("trk_step")
def trk_step(t):
    return tracker.track(t.moving_boxes, box_frames(t))


@query("trk_reset")
def trk_reset(t):
    return tracker.track(t.moving_boxes, box_frames(t).withColumn("epoch", F.floor(F.col("seq") / 100)))


@query("trk_lifecycle", """WITH a AS (SELECT feed_id, track_id, seq, seq - lag(seq) OVER (PARTITION BY feed_id, track_id ORDER BY seq) - 1 AS away FROM observations),
s AS (SELECT *, sum(CASE WHEN away IS NULL OR away > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id, track_id ORDER BY seq) AS run FROM a), h AS (SELECT *, count(*) OVER (PARTITION BY feed_id, track_id, run ORDER BY seq) AS streak FROM s)
SELECT feed_id, track_id, seq, CASE WHEN away > 15 THEN 'Lost' WHEN away > 0 THEN 'Coasted' WHEN streak >= 3 THEN 'Confirmed' ELSE 'Tentative' END AS state FROM h""")
def trk_lifecycle(t):
    config = tracker.Config()
    away = F.col("seq") - F.lag("seq").over(tj.by_track()) - 1
    rows = t.observations.select("feed_id", "track_id", "seq", away.alias("away"))
    rows = rows.withColumn("run", F.sum((F.coalesce("away", F.lit(1)) > 0).cast("int")).over(tj.so_far()))
    streak = F.count("*").over(Window.partitionBy("feed_id", "track_id", "run").orderBy("seq"))
    state = F.when(F.col("away") > config.max_age // 2, "Lost").when(F.col("away") > 0, "Coasted").when(streak >= config.min_hits, "Confirmed").otherwise("Tentative")
    return rows.select("feed_id", "track_id", "seq", state.alias("state"))


@query("trk_mock", "SELECT feed_id, seq, det_id, cast(row_number() OVER (PARTITION BY feed_id ORDER BY seq, det_id) AS bigint) AS track_id, 'Confirmed' AS state FROM detections")
def trk_mock(t):
    number = F.row_number().over(Window.partitionBy("feed_id").orderBy("seq", "det_id")).cast("long")
    return t.detections.select("feed_id", "seq", "det_id", number.alias("track_id"), F.lit("Confirmed").alias("state"))


@query("st_close_all", """WITH k AS (SELECT *, cast((seq - seq % 1000) / 1000 AS bigint) AS session FROM track_points),
d AS (SELECT *, coalesce(max(CASE WHEN state = 'Lost' THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM k WINDOW w AS (PARTITION BY feed_id, session, track_id ORDER BY seq)),
e AS (SELECT *, lag(epoch) OVER (PARTITION BY feed_id, session, track_id ORDER BY seq) AS e0 FROM d WHERE gone = 0),
g AS (SELECT feed_id, session, track_id, count(*) FILTER (e0 IS NULL OR e0 <> epoch) AS segment, arg_max(state, seq) AS last_state FROM e GROUP BY ALL)
SELECT feed_id, session, track_id, segment, 'FeedRestart' AS closed_by FROM (SELECT *, max(session) OVER (PARTITION BY feed_id) AS last FROM g) WHERE session < last AND last_state <> 'Lost'""")
def st_close_all(t):
    # each feed restarts at every thousandth frame
    return tj.closed_by_restart(t.track_points, F.floor(F.col("seq") / 1000))


def filtered(t, step):
    """``step`` of the tracker's filter on fresh tracks of all detections, in batches: columns cx, cy, area and the first variance."""
    z = Box.of().measurement()
    rows = t.detections.select("feed_id", "seq", "det_id", "conf", *[c.alias(n) for n, c in zip(("z0", "z1", "z2", "z3"), z, strict=True)])

    def run(batches):
        for pdf in batches:
            z = pdf[["z0", "z1", "z2", "z3"]].to_numpy()
            v = pdf["conf"].to_numpy()
            x = np.concatenate([z, v[:, None] / 10, v[:, None] / 20, -v[:, None] / 5], axis=1)
            x, p = step(x, np.repeat(np.diag([10.0] * 4 + [1000.0] * 3)[None], len(z), axis=0), z)
            yield pdf[["feed_id", "seq", "det_id"]].assign(cx=x[:, 0].round(6), cy=x[:, 1].round(6), area=x[:, 2].round(6), variance=p[:, 0, 0].round(6))

    return rows.mapInPandas(run, "feed_id long, seq long, det_id long, cx double, cy double, area double, variance double")


@query("trk_predict", """WITH z AS (SELECT feed_id, seq, det_id, conf, x_min + (x_max - x_min) / 2 AS cx, y_min + (y_max - y_min) / 2 AS cy, greatest((x_max - x_min) * (y_max - y_min) - conf / 5, 1e-6) AS area FROM detections)
SELECT feed_id, seq, det_id, round(cx + conf / 10, 6) AS cx, round(cy + conf / 20, 6) AS cy, round(area, 6) AS area, round(1010 + area / 400, 6) AS variance FROM z""")
def trk_predict(t):
    return filtered(t, lambda x, p, z: tracker.predicted(x, p))


@query("trk_update", """WITH z AS (SELECT feed_id, seq, det_id, x_min + (x_max - x_min) / 2 AS cx, y_min + (y_max - y_min) / 2 AS cy, (x_max - x_min) * (y_max - y_min) AS area FROM detections), k AS (SELECT *, 10 / (10 + area / 400) AS k FROM z)
SELECT feed_id, seq, det_id, round(cx + k / 100, 6) AS cx, round(cy, 6) AS cy, round(area, 6) AS area, round(10 - 10 * k, 6) AS variance FROM k""")
def trk_update(t):
    moved = np.array([0.01, 0.0, 0.0, 0.0])
    return filtered(t, lambda x, p, z: tracker.corrected(x, p, z + moved))


@query("trk_reupdate")
def trk_reupdate(t):
    def again(x, p, z):
        x, p = tracker.predicted(np.concatenate([z, np.zeros((len(z), 3))], axis=1), p)
        return tracker.corrected(x, p, z)

    return filtered(t, again)
