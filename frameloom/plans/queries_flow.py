"""Queries of flow, metrics, pipelines and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.operators import flow, metrics, view
from frameloom.plans import pipeline
from frameloom.plans.queries_frames import PHASE, STABLE, STABLE_ROWS, VALID, VIEW
from frameloom.plans.queries_scalar import r6
from frameloom.registry import query

NOW_NS = 1_800_000_000_000_000_000  # the wall clock of replayed lag checks


@query("flt_frame_lag", "SELECT event_id, age_ns FROM (SELECT event_id, epoch_us(ts) * 1000 AS w, epoch_us(ts) * 1000 + cast(floor(value * 50000000) AS bigint) - epoch_us(ts) * 1000 AS age_ns FROM events) WHERE w > 0 AND age_ns >= 2000000000")
def flt_frame_lag(t):
    wall = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    rows = t.events.select("event_id", wall.alias("wall_ns"), (wall + F.floor(F.col("value") * 50_000_000)).alias("now_ns"))
    age = F.col("now_ns") - F.col("wall_ns")
    return rows.filter((F.col("wall_ns") > 0) & (age >= flow.LAG_NS)).select("event_id", age.alias("age_ns"))


@query("win_frame_age", f"SELECT feed_id, seq, CASE WHEN seq % 7 <> 0 AND {NOW_NS} - ts_ns > 0 THEN {NOW_NS} - ts_ns END AS age_ns FROM observations")
def win_frame_age(t):
    wall = F.when(F.col("seq") % 7 != 0, F.col("ts_ns"))  # null stands for a frame without a wall clock
    return t.observations.select("feed_id", "seq", F.when(F.lit(NOW_NS) - wall > 0, F.lit(NOW_NS) - wall).alias("age_ns"))


@query("win_sample", "SELECT feed_id, seq FROM (SELECT feed_id, seq, row_number() OVER (PARTITION BY feed_id ORDER BY seq) % 6 = 0 AS keep FROM reports) WHERE keep")
def win_sample(t):
    return t.reports.withColumn("keep", flow.sampled(6)).filter("keep").select("feed_id", "seq")


FPS = "f AS (SELECT feed_id, CASE WHEN count(*) >= 30 THEN (count(*) - 1) / ((max(ts_ns) - min(ts_ns)) / 1e9) END AS fps FROM (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY seq) AS nth FROM reports) WHERE nth <= 30 GROUP BY feed_id)"


@query("agg_source_fps", f"WITH {FPS} SELECT feed_id, round(fps, 6) AS fps FROM f")
def agg_source_fps(t):
    return flow.source_fps(t.reports).select("feed_id", r6(F.col("fps"), "fps"))


@query("win_target_fps", f"WITH {FPS}, k AS (SELECT r.feed_id, seq, row_number() OVER (PARTITION BY r.feed_id ORDER BY seq) AS nth, cast(CASE WHEN 5e0 >= fps THEN 1 ELSE floor(fps / 5e0 + 0.5e0) END AS bigint) AS interval FROM reports r JOIN f ON r.feed_id = f.feed_id) SELECT feed_id, seq, interval, CASE WHEN nth <= 30 THEN nth % 10 = 0 ELSE (nth - 30) % interval = 0 END AS included FROM k")
def win_target_fps(t):
    return flow.to_target_fps(t.reports, 5.0, 10).select("feed_id", "seq", "interval", "included")


@query("agg_fps_ema", """WITH RECURSIVE l AS (SELECT feed_id, list(ts_ns ORDER BY seq) AS ts, list(seq ORDER BY seq) AS ss FROM observations GROUP BY feed_id),
r(feed_id, k, v) AS (SELECT feed_id, cast(1 AS bigint), 0e0 FROM l UNION ALL SELECT l.feed_id, k + 1, CASE WHEN ts[k + 1] > ts[k] THEN CASE WHEN v = 0 THEN 1e9 / (ts[k + 1] - ts[k]) ELSE v + 0.05e0 * (1e9 / (ts[k + 1] - ts[k]) - v) END ELSE v END FROM r JOIN l ON r.feed_id = l.feed_id AND k < len(ts))
SELECT r.feed_id, ss[k] AS seq, round(v, 6) AS fps FROM r JOIN l ON r.feed_id = l.feed_id""")
def agg_fps_ema(t):
    return flow.smoothed_fps(t.observations).select("feed_id", "seq", r6(F.col("fps"), "fps"))


def queue_sql(depth: int) -> str:
    """One step serves the longest waiting row if its turn comes before the next arrival, else takes that arrival in."""
    return f"""WITH RECURSIVE l AS (SELECT feed_id, list({{'a': arrival_ns, 'v': service_ns, 's': seq}} ORDER BY arrival_ns, seq) AS es FROM arrivals GROUP BY feed_id),
r(feed_id, k, w, free_at, seq, dropped, hold_ns, done_ns) AS (SELECT feed_id, cast(0 AS bigint), es[1:0], cast(0 AS bigint), cast(NULL AS bigint), false, cast(NULL AS bigint), cast(NULL AS bigint) FROM l UNION ALL
 SELECT feed_id, CASE WHEN turn THEN k ELSE k + 1 END, CASE WHEN turn THEN w[2:] WHEN len(w) >= {depth} THEN list_append(w[2:], e) ELSE list_append(w, e) END, CASE WHEN turn THEN begun + w[1].v ELSE free_at END,
  CASE WHEN turn OR len(w) >= {depth} THEN w[1].s END, NOT turn, CASE WHEN turn THEN begun - w[1].a END, CASE WHEN turn THEN begun + w[1].v END
 FROM (SELECT r.feed_id, k, w, free_at, es[k + 1] AS e, greatest(free_at, w[1].a) AS begun, len(w) > 0 AND (k = len(es) OR greatest(free_at, w[1].a) <= es[k + 1].a) AS turn FROM r JOIN l ON r.feed_id = l.feed_id AND (k < len(es) OR len(w) > 0)) AS s)
"""


@query("strm_queue", f"{queue_sql(4)} SELECT feed_id, seq, dropped, hold_ns, done_ns FROM r WHERE seq IS NOT NULL")
def strm_queue(t):
    return flow.queued(t.arrivals)


@query("top_drop_oldest", f"{queue_sql(2)} SELECT feed_id, seq FROM r WHERE seq IS NOT NULL AND dropped")
def top_drop_oldest(t):
    return flow.queued(t.arrivals, depth=2).filter("dropped").select("feed_id", "seq")


@query("strm_batch_form", """WITH RECURSIVE l AS (SELECT feed_id, list(arrival_ns ORDER BY arrival_ns, seq) AS a, list(seq ORDER BY arrival_ns, seq) AS s FROM arrivals GROUP BY feed_id),
r(feed_id, k, batch_id, place, deadline) AS (SELECT feed_id, cast(1 AS bigint), cast(0 AS bigint), cast(1 AS bigint), a[1] + 30000000000 FROM l UNION ALL
 SELECT l.feed_id, k + 1, CASE WHEN place >= 4 OR a[k + 1] > deadline THEN batch_id + 1 ELSE batch_id END, CASE WHEN place >= 4 OR a[k + 1] > deadline THEN 1 ELSE place + 1 END, CASE WHEN place >= 4 OR a[k + 1] > deadline THEN a[k + 1] + 30000000000 ELSE deadline END FROM r JOIN l ON r.feed_id = l.feed_id AND k < len(a))
SELECT r.feed_id, s[k] AS seq, batch_id, place FROM r JOIN l ON r.feed_id = l.feed_id""")
def strm_batch_form(t):
    return flow.batched(t.arrivals, 4, 30_000_000_000)


# one step answers the batch at the front if that is due before the next submission, else settles that submission; ``w`` waits,
# ``b`` is gathered, ``done`` are answers to come (one in flight a feed, four a batch, sixteen waiting, 50 ms and 5 s)
@query("strm_batch_submit", """WITH RECURSIVE l AS (SELECT list({'f': feed_id, 's': seq, 'a': arrival_ns, 'v': service_ns} ORDER BY arrival_ns, feed_id, seq) AS es FROM arrivals),
r(k, free_at, begun, w, b, done, settled) AS (SELECT cast(0 AS bigint), cast(0 AS bigint), cast(0 AS bigint), es[1:0], es[1:0], [{'f': cast(0 AS bigint), 'd': cast(0 AS bigint)}][1:0], [{'f': cast(0 AS bigint), 's': cast(0 AS bigint), 'o': ''}][1:0] FROM l UNION ALL
 SELECT CASE WHEN due THEN k ELSE k + 1 END, CASE WHEN due THEN answered ELSE free_at END, beg, CASE WHEN due OR cause <> '' THEN w ELSE list_append(w, e) END, CASE WHEN due THEN w[1:0] ELSE b END,
  CASE WHEN due THEN list_concat(done, list_transform(b, lambda x: {'f': x.f, 'd': answered})) ELSE done END,
  CASE WHEN due THEN list_transform(b, lambda x: {'f': x.f, 's': x.s, 'o': CASE WHEN answered - x.a > 5050000000 THEN 'Timeout' ELSE 'Accepted' END}) WHEN cause <> '' THEN [{'f': e.f, 's': e.s, 'o': cause}] ELSE [{'f': e.f, 's': e.s, 'o': cause}][1:0] END
 FROM (SELECT *, CASE WHEN len(b) >= 4 THEN greatest(beg, b[-1].a) ELSE beg + 50000000 END + list_max(list_transform(b, lambda x: x.v)) AS answered, len(b) > 0 AND (len(b) >= 4 OR e IS NULL OR beg + 50000000 <= e.a) AS due,
   CASE WHEN len(list_filter(w, lambda x: x.f = e.f)) + len(list_filter(b, lambda x: x.f = e.f)) + len(list_filter(done, lambda x: x.f = e.f)) >= 1 THEN 'InFlightCapReached' WHEN len(w) >= 16 THEN 'QueueFull' ELSE '' END AS cause
  FROM (SELECT k, free_at, beg, e, list_filter(done, lambda x: e IS NULL OR x.d > e.a) AS done, CASE WHEN open THEN list_concat(b, w[1:4 - len(b)]) ELSE b END AS b, CASE WHEN open THEN w[5 - len(b):] ELSE w END AS w
   FROM (SELECT k, free_at, w, b, done, e, CASE WHEN len(b) > 0 THEN begun ELSE greatest(free_at, w[1].a) END AS beg, len(b) > 0 OR (len(w) > 0 AND (e IS NULL OR greatest(free_at, w[1].a) <= e.a)) AS open
    FROM (SELECT r.*, CASE WHEN k < len(es) THEN es[k + 1] END AS e FROM r, l WHERE k < len(es) OR len(w) > 0 OR len(b) > 0) AS s) AS s) AS s) AS s)
SELECT x.f AS feed_id, x.s AS seq, x.o AS outcome FROM (SELECT unnest(settled) AS x FROM r) AS s""")
def strm_batch_submit(t):
    return flow.submitted(t.arrivals, size=flow.BATCH_SIZE)


@query("strm_batch_exec", "SELECT processor_id, CASE WHEN ok THEN 'routed' ELSE 'failed' END AS outcome, cast(sum(size) AS bigint) AS items FROM batch_dispatches GROUP BY ALL")
def strm_batch_exec(t):
    outcome = F.when(F.col("ok"), "routed").otherwise("failed")  # an error fails all items of its batch
    return t.batch_dispatches.groupBy("processor_id", outcome.alias("outcome")).agg(F.sum("size").alias("items"))


def overloads(t):
    bad = F.col("kind").isin("BackpressureDrop", "SinkBackpressure", "FrameLag", "OutputLagged")
    return t.health_events.select("feed_id", "ts_ns", "event_id", bad.alias("bad"), "delta")


@query("strm_coalesce", """WITH RECURSIVE x AS (SELECT feed_id, list({'t': ts_ns, 'bad': kind IN ('BackpressureDrop', 'SinkBackpressure', 'FrameLag', 'OutputLagged'), 'd': delta} ORDER BY ts_ns, event_id) AS es FROM health_events GROUP BY feed_id),
r(feed_id, k, lit, g, since, ts_ns, kind, n) AS (SELECT feed_id, cast(0 AS bigint), false, cast(0 AS bigint), cast(0 AS bigint), cast(NULL AS bigint), cast(NULL AS varchar), cast(NULL AS bigint) FROM x UNION ALL
 SELECT feed_id, k + 1, e.bad, CASE WHEN held THEN g + e.d ELSE 0 END, CASE WHEN e.bad AND NOT held THEN e.t ELSE since END, e.t, CASE WHEN NOT e.bad THEN CASE WHEN lit AND g > 0 THEN 'recovered' END WHEN NOT held THEN CASE WHEN lit THEN 'ongoing' ELSE 'began' END END, CASE WHEN e.bad THEN g + e.d ELSE g END
 FROM (SELECT r.feed_id, k, lit, g, since, es[k + 1] AS e, lit AND es[k + 1].bad AND es[k + 1].t - since < 1000000000 AS held FROM r JOIN x ON r.feed_id = x.feed_id AND k < len(es)) AS s)
SELECT feed_id, ts_ns, kind, n FROM r WHERE kind IS NOT NULL UNION ALL SELECT r.feed_id, ts_ns, 'stopped', g FROM r JOIN x ON r.feed_id = x.feed_id AND k = len(es) AND lit AND g > 0""")
def strm_coalesce(t):
    return flow.coalesced(overloads(t))


@query("strm_output_lag", """WITH s AS (SELECT feed_id, seq, 1 + seq % 3 AS sent, CASE WHEN seq % 40 < 25 THEN 1 ELSE 4 END AS drained FROM reports),
l AS (SELECT feed_id, seq, cast(greatest(sum(sent - drained) OVER (PARTITION BY feed_id ORDER BY seq) - 8, 0) AS bigint) AS lost FROM s), b AS (SELECT *, coalesce(lag(lost) OVER (PARTITION BY feed_id ORDER BY seq), 0) AS before FROM l)
SELECT feed_id, seq, lost, CASE WHEN lost > 0 AND before = 0 THEN 'began' WHEN lost = 0 AND before > 0 THEN 'ended' END AS transition FROM b""")
def strm_output_lag(t):
    rows = t.reports.select("feed_id", "seq", (1 + F.col("seq") % 3).alias("sent"), F.when(F.col("seq") % 40 < 25, 1).otherwise(4).cast("long").alias("drained"))
    return flow.output_lag(rows, 8).select("feed_id", "seq", "lost", "transition")


@query("strm_health", f"WITH {VIEW} SELECT feed_id, 'ViewEpochChanged' AS kind, count(*) AS n FROM v WHERE decision = 'Segment' GROUP BY ALL UNION ALL SELECT feed_id, kind, count(*) FROM health_events GROUP BY ALL")
def strm_health(t):
    changes = view.decided(t.reports).filter("decision = 'Segment'").select("feed_id", F.lit("ViewEpochChanged").alias("kind"))
    count = lambda df: df.groupBy("feed_id", "kind").agg(F.count("*").alias("n"))
    return count(changes).unionByName(count(t.health_events))


@query("strm_windows", "SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_us, count(*) AS n FROM events GROUP BY ALL")
def strm_windows(t):
    g = t.events.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return g.select("event_type", F.unix_micros("w.start").alias("window_us"), "n")


@query("src_fsm", """WITH RECURSIVE x AS (SELECT feed_id, list({'t': ts_ns, 'id': event_id, 'kind': ['StreamStarted', 'Error', 'Warning', 'Eos', 'Pause', 'Resume', 'Timeout'][event_id % 7 + 1], 'loops': event_id % 11 <> 0} ORDER BY ts_ns, event_id) AS es FROM observations GROUP BY feed_id),
r(feed_id, k, ts_ns, event_id, kind, state, attempts) AS (SELECT feed_id, cast(0 AS bigint), cast(0 AS bigint), cast(0 AS bigint), '', 'Idle', cast(0 AS bigint) FROM x UNION ALL
 SELECT feed_id, k + 1, e.t, e.id, e.kind, CASE WHEN state = 'Stopped' OR (e.kind = 'Eos' AND NOT e.loops) THEN 'Stopped' WHEN e.kind = 'StreamStarted' THEN 'Running' WHEN e.kind IN ('Error', 'Timeout', 'Eos') THEN 'Reconnecting' WHEN e.kind = 'Pause' AND state = 'Running' THEN 'Paused' WHEN e.kind = 'Resume' AND state = 'Paused' THEN 'Running' ELSE state END,
  CASE WHEN state = 'Stopped' OR (e.kind = 'Eos' AND NOT e.loops) THEN attempts WHEN e.kind = 'StreamStarted' THEN 0 WHEN e.kind IN ('Error', 'Timeout', 'Eos') THEN attempts + 1 ELSE attempts END
 FROM (SELECT r.feed_id, k, state, attempts, es[k + 1] AS e FROM r JOIN x ON r.feed_id = x.feed_id AND k < len(es)) AS s)
SELECT feed_id, ts_ns, event_id, kind, state, attempts FROM r WHERE k > 0""")
def src_fsm(t):
    kinds = F.array(*map(F.lit, ("StreamStarted", "Error", "Warning", "Eos", "Pause", "Resume", "Timeout")))
    rows = t.observations.select("feed_id", "ts_ns", "event_id", F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("kind"), (F.col("event_id") % 11 != 0).alias("loops"))
    return flow.source_states(rows)


@query("rt_restart", """WITH RECURSIVE x AS (SELECT feed_id, list({'s': seq, 'u': (k % 400) * 1000000000} ORDER BY seq) AS es FROM reports GROUP BY feed_id),
r(feed_id, k, ok, c) AS (SELECT feed_id, cast(0 AS bigint), false, cast(0 AS bigint) FROM x UNION ALL SELECT x.feed_id, k + 1, es[k + 1].u >= 300000000000 OR c < 5, CASE WHEN es[k + 1].u >= 300000000000 THEN 1 WHEN c < 5 THEN c + 1 ELSE c END FROM r JOIN x ON r.feed_id = x.feed_id AND k < len(es))
SELECT r.feed_id, es[k].s AS seq, ok AS restarted, c AS restarts FROM r JOIN x ON r.feed_id = x.feed_id WHERE k > 0""")
def rt_restart(t):
    exits = t.reports.select("feed_id", "seq", ((F.col("k") % 400) * 1_000_000_000).alias("uptime_ns"), F.lit("Stage").alias("fault"))
    return flow.restarts(exits)


EXITS = "(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Shutdown' WHEN 1 THEN 'Eos' WHEN 2 THEN 'StagePanic' WHEN 3 THEN 'SourceFailure' ELSE 'SinkLost' END AS ended FROM events)"


@query("rt_stop_reason", f"SELECT event_id, CASE ended WHEN 'Shutdown' THEN 'UserRequested' WHEN 'Eos' THEN 'EndOfStream' WHEN 'SinkLost' THEN 'Fatal' ELSE 'RestartLimitExceeded' END AS reason FROM {EXITS}")
def rt_stop_reason(t):
    ended = F.element_at(F.array(*map(F.lit, ("Shutdown", "Eos", "StagePanic", "SourceFailure", "SinkLost"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", pipeline.stop_reason(ended).alias("reason"))


@query("agg_counters", f"SELECT feed_id, kind, cast(sum(CASE WHEN kind IN {metrics.DELTA_KINDS} THEN delta ELSE 1 END) AS bigint) AS n FROM health_events WHERE kind NOT IN {metrics.UNCOUNTED_KINDS} GROUP BY ALL")
def agg_counters(t):
    return metrics.health_counters(t.health_events)


BATCH = """b AS (SELECT *, sum(cast(ok AS int)) OVER (PARTITION BY processor_id ORDER BY dispatch_id) AS run FROM batch_dispatches), c AS (SELECT *, run = max(run) OVER (PARTITION BY processor_id) AND NOT ok AS tail FROM b),
g AS (SELECT processor_id, count(*) AS dispatched, cast(sum(size) AS bigint) AS items, cast(sum(submitted) AS bigint) AS submitted, cast(sum(rejected) AS bigint) AS rejected, cast(sum(timed_out) AS bigint) AS timed_out,
min(size) AS min_size, max(size) AS max_size, count(*) FILTER (tail) AS consecutive_errors, sum(processing_ns)::DOUBLE AS p, sum(formation_ns)::DOUBLE AS f FROM c GROUP BY processor_id)
"""
PENDING = "greatest(submitted - items - rejected, 0) AS pending_items"


@query("agg_batch_metrics", f"WITH {BATCH} SELECT processor_id, dispatched, items, submitted, rejected, timed_out, {PENDING}, min_size, max_size, consecutive_errors, round(rejected / submitted, 6) AS rejection_rate, round(timed_out / submitted, 6) AS timeout_rate, round(items / dispatched, 6) AS avg_batch_size, round(items / (dispatched * 8), 6) AS avg_fill_ratio, round(p / dispatched, 3) AS avg_processing_ns, round(f / dispatched, 3) AS avg_formation_ns FROM g")
def agg_batch_metrics(t):
    m = metrics.batch_metrics(t.batch_dispatches, 8)
    rates = [r6(F.col(c), c) for c in ("rejection_rate", "timeout_rate", "avg_batch_size", "avg_fill_ratio")]
    counts = ("dispatched", "items", "submitted", "rejected", "timed_out", "pending_items", "min_size", "max_size", "consecutive_errors")
    return m.select("processor_id", *counts, *rates, *[F.round(c, 3).alias(c) for c in ("avg_processing_ns", "avg_formation_ns")])


FRAMES = f"WITH {VIEW}, {PHASE}, fr AS (SELECT feed_id, seq, epoch, k % 50 = 0 AS dropped, k % 20 AS tracks FROM q)"


def frames(t):
    v = view.decided(t.reports)
    return v.select("feed_id", "seq", view.epoch().alias("epoch"), (F.col("k") % 50 == 0).alias("dropped"), (F.col("k") % 20).alias("tracks"))


FEEDS = """r AS (SELECT feed_id, count(*) AS restarts FROM health_events WHERE kind = 'FeedRestarting' GROUP BY feed_id),
fm AS (SELECT fr.feed_id, count(*) AS frames_received, count(*) FILTER (dropped) AS frames_dropped, count(*) FILTER (NOT dropped) AS frames_processed, arg_max(tracks, seq) AS tracks_active, max(epoch) AS view_epoch, max(seq) AS last_seq FROM fr GROUP BY fr.feed_id),
m AS (SELECT fm.*, coalesce(restarts, 0) AS restarts FROM fm LEFT JOIN r ON fm.feed_id = r.feed_id)
"""


@query("agg_feed_metrics", f"{FRAMES}, {FEEDS} SELECT feed_id, frames_received, frames_dropped, frames_processed, tracks_active, view_epoch, restarts FROM m")
def agg_feed_metrics(t):
    return metrics.feed_metrics(frames(t), t.health_events)


def feed_state(t):
    """A feed's metrics with the view status and stability of its last frame."""
    rows = view.decided(t.reports)
    status = F.when(view.validity() == "Valid", "Stable").otherwise("Degraded")
    last = metrics.latest(rows.select("feed_id", "seq", metrics.status_number(status).alias("view_status")))
    stable = metrics.latest(view.stability(rows).select("feed_id", "seq", F.round("stability", 6).alias("view_stability_score")))
    return metrics.feed_metrics(frames(t), t.health_events).join(last.join(stable, ["feed_id", "seq"]), "feed_id")


STATE = f""", {VALID}, {STABLE}, vs AS (SELECT feed_id, arg_max(CASE WHEN validity = 'Valid' THEN 0 ELSE 1 END, seq) AS view_status FROM w GROUP BY feed_id),
sc AS (SELECT feed_id, arg_max(stability, seq) AS view_stability_score FROM ({STABLE_ROWS}) AS y GROUP BY feed_id)
"""


def _unpivoted(kind: str, source: str, subject: str, values: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{kind}.{n}' AS gauge, {subject} AS subject, ({values.get(n, n)})::DOUBLE AS value FROM {source}" for n in metrics.GAUGES[kind])


LOST = "(SELECT coalesce(sum(delta), 0) FROM health_events WHERE kind = 'OutputLagged')"
WHOLE = f"(SELECT max(last_seq) / 10 AS uptime_seconds, count(*) AS feed_count, 64 AS max_feeds, {LOST} > 0 AS output_lag, {LOST} AS output_lag_pending_lost FROM m) AS x"
FEED_SQL = {
    "alive": "1", "paused": "0", "uptime_seconds": "last_seq / 10", "queue_source_depth": "last_seq % 5", "queue_source_capacity": "4", "queue_sink_depth": "last_seq % 17", "queue_sink_capacity": "16",
}
BATCH_SQL = {
    "items_processed": "items", "items_submitted": "submitted", "items_rejected": "rejected", "items_timed_out": "timed_out", "avg_processing_ms": "round(p / dispatched / 1e6, 6)",
    "avg_formation_ms": "round(f / dispatched / 1e6, 6)", "avg_fill_ratio": "round(items / (dispatched * 8), 6)", "pending_items": "greatest(submitted - items - rejected, 0)",
}


@query("agg_gauges", f"{FRAMES.replace('WITH', 'WITH RECURSIVE', 1)}, {FEEDS}{STATE}, {BATCH}, st AS (SELECT m.*, view_status, view_stability_score FROM m JOIN vs ON m.feed_id = vs.feed_id JOIN sc ON m.feed_id = sc.feed_id) SELECT * FROM ({_unpivoted('runtime', WHOLE, chr(39) * 2, {})} UNION ALL {_unpivoted('feed', 'st', 'feed_id::VARCHAR', FEED_SQL)} UNION ALL {_unpivoted('batch', 'g', 'processor_id', BATCH_SQL)}) AS z WHERE value IS NOT NULL")
def agg_gauges(t):
    n, put = F.col("seq"), lambda v: F.lit(v)
    uptime = {"uptime_seconds": n / 10}
    queues = {"queue_source_depth": n % 5, "queue_source_capacity": put(4), "queue_sink_depth": n % 17, "queue_sink_capacity": put(16)}
    feeds = feed_state(t).withColumns({"alive": put(True), "paused": put(False), **uptime, **queues})
    whole = feeds.agg(F.max("uptime_seconds").alias("uptime_seconds"), F.count("*").alias("feed_count"))
    lost = t.health_events.filter("kind = 'OutputLagged'").agg(F.coalesce(F.sum("delta"), put(0)).alias("output_lag_pending_lost"))
    whole = whole.join(lost, put(True)).withColumns({"max_feeds": put(64), "output_lag": F.col("output_lag_pending_lost") > 0})  # one row each
    batches = metrics.batch_metrics(t.batch_dispatches, 8).withColumn("avg_fill_ratio", F.round("avg_fill_ratio", 6))
    return metrics.gauges("runtime", whole, put("")).unionByName(metrics.gauges("feed", feeds, F.col("feed_id"))).unionByName(metrics.batch_gauges(batches))


@query("agg_diag", f"{FRAMES}, {FEEDS}, {BATCH} SELECT (SELECT string_agg(feed_id || ':' || last_seq || ':' || tracks_active || ':' || restarts, ',' ORDER BY feed_id) FROM m) AS feeds, (SELECT string_agg(processor_id || ':' || dispatched || ':' || {PENDING.split(' AS ')[0]}, ',' ORDER BY processor_id) FROM g) AS batches")
def agg_diag(t):
    last = metrics.latest(frames(t)).select("feed_id", F.col("seq").alias("last_seq"))
    feeds = metrics.feed_metrics(frames(t), t.health_events).join(last, "feed_id").select("feed_id", "last_seq", "tracks_active", "restarts")
    batches = metrics.batch_metrics(t.batch_dispatches, 8).select("processor_id", "dispatched", "pending_items")
    line = lambda name, *fields: F.array_join(F.transform(name, lambda p: F.concat_ws(":", *[p[c] for c in fields])), ",").alias(name)
    return metrics.diagnostics(feeds, batches).select(line("feeds", *feeds.columns), line("batches", *batches.columns))


@query("ord_diag", FRAMES + " SELECT feed_id, max(seq) AS seq FROM fr GROUP BY feed_id ORDER BY feed_id")
def ord_diag(t):
    return metrics.latest(frames(t)).select("feed_id", "seq").orderBy("feed_id")


@query("sink_ui_latest", FRAMES + " SELECT feed_id, max(seq) AS last_seq, max(seq) FILTER (seq % 6 = 5) AS last_framed FROM fr GROUP BY feed_id")
def sink_ui_latest(t):
    return frames(t).groupBy("feed_id").agg(F.max("seq").alias("last_seq"), F.max(F.when(F.col("seq") % 6 == 5, F.col("seq"))).alias("last_framed"))


@query("sink_log", "SELECT feed_id, seq FROM (SELECT feed_id, seq, row_number() OVER (PARTITION BY feed_id ORDER BY seq) AS n FROM reports) WHERE n % 60 = 0")
def sink_log(t):
    return t.reports.withColumn("keep", flow.sampled(60)).filter("keep").select("feed_id", "seq")


@query("agg_admission", "SELECT feed_id, seq, count(*) FILTER (conf >= 0.95e0) AS admitted, count(*) FILTER (conf < 0.95e0) AS rejected FROM detections GROUP BY ALL")
def agg_admission(t):
    ok = F.col("conf") >= 0.95
    return t.detections.groupBy("feed_id", "seq").agg(F.count_if(ok).alias("admitted"), F.count_if(~ok).alias("rejected"))


@query("agg_signal_track_count", "SELECT feed_id, count(*) AS track_count, count(*) FILTER (n >= 100) AS long_dwell_tracks FROM (SELECT feed_id, track_id, count(*) AS n FROM observations GROUP BY ALL) GROUP BY feed_id")
def agg_signal_track_count(t):
    n = t.observations.groupBy("feed_id", "track_id").agg(F.count("*").alias("n"))
    return n.groupBy("feed_id").agg(F.count("*").alias("track_count"), F.count_if(F.col("n") >= 100).alias("long_dwell_tracks"))


@query("agg_stage_metrics", "SELECT stage_id, count(*) AS frames_processed, count(error) AS errors FROM stage_runs GROUP BY stage_id")
def agg_stage_metrics(t):
    return t.stage_runs.groupBy("stage_id").agg(F.count("*").alias("frames_processed"), F.count("error").alias("errors"))


@query("win_stage_latency", "SELECT feed_id, seq, max(end_ns) - min(start_ns) AS total_ns, cast(sum(end_ns - start_ns) AS bigint) AS stage_ns FROM stage_runs GROUP BY ALL")
def win_stage_latency(t):
    return t.stage_runs.groupBy("feed_id", "seq").agg((F.max("end_ns") - F.min("start_ns")).alias("total_ns"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("stage_ns"))


@query("pipe_linear", "SELECT feed_id, seq, det_id, round((x_min + x_max) / 2, 6) AS cx, conf >= 0.95e0 AS sure FROM detections WHERE conf >= 0.92e0")
def pipe_linear(t):
    p = pipeline.Pipeline()
    p.add(pipeline.Stage("detect", lambda df: df.filter("conf >= 0.92"), produces=frozenset({"detections"})))
    p.add(pipeline.Stage("centre", lambda df: df.withColumn("cx", F.round((F.col("x_min") + F.col("x_max")) / 2, 6)), frozenset({"detections"})))
    p.add(pipeline.Stage("rate", lambda df: df.withColumn("sure", F.col("conf") >= 0.95), frozenset({"detections"})))
    return p.run(t.detections).select("feed_id", "seq", "det_id", "cx", "sure")


@query("pipe_merge", """WITH o AS (SELECT feed_id, seq, det_id AS stage_no, CASE WHEN det_id % 2 = 1 THEN class_id END AS detections, CASE WHEN det_id % 3 = 0 THEN class_id END AS tracks, 's' || det_id AS signal, CASE WHEN det_id % 4 < 2 THEN 'f' || class_id END AS feature FROM detections)
SELECT feed_id, seq, arg_max(detections, stage_no) FILTER (detections IS NOT NULL) AS detections, arg_max(tracks, stage_no) FILTER (tracks IS NOT NULL) AS tracks, count(tracks) > 0 AS authoritative, string_agg(signal, ',' ORDER BY stage_no) AS signals, coalesce(string_agg(feature, ',' ORDER BY stage_no), '') AS scene_features, arg_max(signal, stage_no) AS artifact FROM o GROUP BY ALL""")
def pipe_merge(t):
    signal = F.concat(F.lit("s"), F.col("det_id").cast("string"))
    rows = t.detections.select("feed_id", "seq", F.col("det_id").alias("stage_no"), F.when(F.col("det_id") % 2 == 1, F.col("class_id")).alias("detections"), F.when(F.col("det_id") % 3 == 0, F.col("class_id")).alias("tracks"), F.array(signal).alias("signals"), F.when(F.col("det_id") % 4 < 2, F.array(F.concat(F.lit("f"), F.col("class_id").cast("string")))).alias("scene_features"), F.create_map(F.lit("mark"), signal).alias("artifacts"))
    m = pipeline.merged(rows)
    return m.select("feed_id", "seq", "detections", "tracks", "authoritative", F.array_join("signals", ",").alias("signals"), F.array_join("scene_features", ",").alias("scene_features"), F.col("artifacts")["mark"].alias("artifact"))


SURVIVE = "WITH f AS (SELECT feed_id, seq, min({'a': start_ns, 'b': stage_id}) FILTER (error IS NOT NULL) AS stop FROM stage_runs GROUP BY ALL), s AS (SELECT r.*, stop IS NOT NULL AS frame_dropped FROM stage_runs r JOIN f ON r.feed_id = f.feed_id AND r.seq = f.seq WHERE stop IS NULL OR {'a': start_ns, 'b': stage_id} <= stop)"


@query("pipe_error", SURVIVE + " SELECT feed_id, seq, count(*) AS stages_run, bool_or(frame_dropped) AS frame_dropped FROM s GROUP BY ALL")
def pipe_error(t):
    return pipeline.surviving(t.stage_runs).groupBy("feed_id", "seq").agg(F.count("*").alias("stages_run"), F.bool_or("frame_dropped").alias("frame_dropped"))


@query("pipe_prov", SURVIVE + " SELECT stage_id, coalesce(error, 'Ok') AS result, count(*) AS n, cast(sum(end_ns - start_ns) AS bigint) AS latency_ns FROM s GROUP BY ALL")
def pipe_prov(t):
    return pipeline.surviving(t.stage_runs).groupBy("stage_id", F.coalesce("error", F.lit("Ok")).alias("result")).agg(F.count("*").alias("n"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("latency_ns"))


DECLARED = """WITH d AS (SELECT l_orderkey AS pipeline_id, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS bigint) AS stage_no,
 's' || (l_suppkey % 9) AS stage_id, l_partkey % 2 = 0 AS cd, l_partkey % 3 = 0 AS ct, l_partkey % 5 < 2 AS pd, l_partkey % 7 < 2 AS pt FROM lineitem),
h AS (SELECT *, coalesce(bool_or(pd) OVER w, false) AS hd, coalesce(bool_or(pt) OVER w, false) AS ht, row_number() OVER (PARTITION BY pipeline_id, stage_id ORDER BY stage_no) > 1 AS twice
 FROM d WINDOW w AS (PARTITION BY pipeline_id ORDER BY stage_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT pipeline_id, stage_no, stage_id, 'needs detections' AS problem FROM h WHERE cd AND NOT hd UNION ALL SELECT pipeline_id, stage_no, stage_id, 'needs tracks' FROM h WHERE ct AND NOT ht
UNION ALL SELECT pipeline_id, stage_no, stage_id, 'appears twice' FROM h WHERE twice"""


@query("pipe_validate", DECLARED)
def pipe_validate(t):
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    part = F.col("l_partkey")
    kinds = lambda d, k: F.array_compact(F.array(F.when(d, F.lit("detections")), F.when(k, F.lit("tracks"))))
    stages = t.lineitem.select(
        F.col("l_orderkey").alias("pipeline_id"),
        nth.alias("stage_no"),
        F.concat(F.lit("s"), (F.col("l_suppkey") % 9).cast("string")).alias("stage_id"),
        kinds(part % 2 == 0, part % 3 == 0).alias("consumes"),
        kinds(part % 5 < 2, part % 7 < 2).alias("produces"),
    )
    return pipeline.declared_problems(stages)


@query("strm_batch_validate", """WITH c AS (SELECT o_orderkey, o_orderkey % 5 AS size, (o_custkey % 4) * 25000000 AS latency_ns, o_orderkey % 3 AS in_flight,
 CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 7 END AS queue_capacity, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey % 4 END AS response_timeout_ns FROM orders)
SELECT o_orderkey, concat_ws('; ', CASE WHEN size < 1 THEN 'size must be positive' END, CASE WHEN latency_ns < 1 THEN 'latency_ns must be positive' END, CASE WHEN in_flight < 1 THEN 'in_flight must be positive' END,
 CASE WHEN response_timeout_ns < 1 THEN 'response_timeout_ns must be positive' END, CASE WHEN queue_capacity < size THEN 'queue_capacity must hold a whole batch' END) AS problems FROM c""")
def strm_batch_validate(t):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    configs = t.orders.select(
        "o_orderkey",
        (key % 5).alias("size"),
        (cust % 4 * 25_000_000).alias("latency_ns"),
        (key % 3).alias("in_flight"),
        F.when(cust % 2 == 0, cust % 7).alias("queue_capacity"),
        F.when(cust % 3 == 0, key % 4).alias("response_timeout_ns"),
    )
    return configs.select("o_orderkey", F.array_join(pipeline.batch_problems(configs), "; ").alias("problems"))


@query("sink_output", "SELECT feed_id, seq, decision FROM (SELECT * FROM (WITH " + VIEW + " SELECT feed_id, seq, decision FROM v))")
def sink_output(t):
    from frameloom.streaming.sinks import written

    return written(view.decided(t.reports).select("feed_id", "seq", "decision"), "outputs")


@query("sink_broadcast", "SELECT 'all' AS subscriber, count(*) AS n FROM reports UNION ALL SELECT 'presets', count(*) FROM reports WHERE preset")
def sink_broadcast(t):
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("subscriber"), "n")
    return count(t.reports, "all").unionByName(count(t.reports.filter("preset"), "presets"))


@query("sink_otlp", "SELECT kind, cast(count(*) AS bigint) AS events FROM health_events GROUP BY kind")
def sink_otlp(t):
    return t.health_events.groupBy("kind").agg(F.count("*").alias("events"))
