"""Golden values of single operators, and folds against plain Python and streams."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom import registry
from frameloom.functions import clock, pixels, text
from frameloom.functions.geometry import Box, angular_delta, clamp_unit
from frameloom.operators import association, flow, metrics, store, tracker, trajectory, view
from frameloom.plans.pipeline import BatchConfig, FeedConfig, Pipeline, Stage, batch_problems, declared_problems, merged
from frameloom.sources import media
from frameloom.streaming.sinks import fan_out
from frameloom.streaming.stateful import fold_stream


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geometry(spark):
    a, b = Box(*map(F.lit, (0.0, 0.0, 1.0, 1.0))), Box(*map(F.lit, (0.5, 0.0, 1.5, 1.0)))
    empty = Box(*map(F.lit, (0.3, 0.3, 0.3, 0.3)))
    assert one(spark, F.round(a.iou(b), 6), a.iou(a), empty.iou(empty))[:] == (0.333333, 1.0, 0.0)
    assert one(spark, angular_delta(F.lit(359.0), F.lit(1.0)), angular_delta(F.lit(400.0), F.lit(0.0)))[:] == (2.0, -40.0)
    assert one(spark, *[clamp_unit(F.lit(x)) for x in (float("nan"), float("-inf"), 2.0, -1.0, 0.25)])[:] == (0.0, 0.0, 1.0, 0.0, 0.25)


def test_clock(spark):
    got = one(spark, *[clock.pretty(F.lit(n)) for n in (1_500_000_000, 2_500_000, 1_500, 12)], clock.since(F.lit(1), F.lit(5)))
    assert got[:] == ("1.500s", "2.500ms", "1.5μs", "12ns", None)


def test_text(spark):
    urls = {"rtsp://u:p@cam/x": "rtsp://***@cam/x", "u:p@cam/x": "***@cam/x", "http://h/a@b": "http://h/a@b", "rtsp://a@b@c": "rtsp://***@c"}
    for url, want in urls.items():
        assert one(spark, text.redact_url(F.lit(url)))[0] == want
    lines = {
        "password=abc&x=1 TOKEN=zz; key=": "password=***&x=1 TOKEN=***; key=",
        "Authorization:Bearer abc": "Authorization:*** abc",
        "a\tb\nc": "a b c",
    }
    for line, want in lines.items():
        assert one(spark, text.sanitize(F.lit(line)))[0] == want
    long = one(spark, text.sanitize(F.lit("é" * 400)))[0]
    assert long == "é" * 256 + "...[truncated]"
    assert one(spark, text.promote_tls(F.lit("rtsp://h")), text.promote_tls(F.lit("h/x")), text.promote_tls(F.lit("http://h")))[:] == ("rtsps://h", "rtsps://h/x", "http://h")
    assert one(spark, text.redact_urls(F.lit("see rtsp://u:p@h/x and 'http://k@j'")))[0] == "see rtsp://***@h/x and 'http://***@j'"


def test_pixels(spark):
    image = np.array([[[10, 20, 30], [255, 0, 0]]], dtype=np.uint8)
    assert pixels.convert(image, "Bgr8", "Rgb8").tolist() == [[[30, 20, 10], [0, 0, 255]]]
    assert pixels.convert(image, "Rgb8", "Gray8").tolist() == [[[18], [76]]]
    with pytest.raises(ValueError):
        pixels.convert(image, "Rgb8", "Rgb8")
    box = pixels.letterbox_image(np.full((10, 20, 3), 255, np.uint8), 8)
    assert box.shape == (1, 3, 8, 8) and box[0, 0, 0, 0] == np.float32(114 / 255) and box[0, 0, 4, 4] == 1
    frames = media.mock_frames(spark, 1, 2, 2, 2, 40).withColumn("gray", pixels.convert_column(F.col("data"), F.col("width"), F.col("height"), "Rgb8", "Gray8"))
    assert [bytes(r.gray) for r in frames.collect()] == [bytes([128] * 4)] * 2


def reports(spark, rows):
    ddl = "feed_id long, seq long, ts_ns long, pan double, tilt double, zoom double, conf double, disp double, preset boolean, hint string"
    return spark.createDataFrame([(1, k, k * 10, *r) for k, r in enumerate(rows)], ddl)


def decisions(spark, *rows):
    return [(r.decision, r.reason) for r in view.decided(reports(spark, rows)).orderBy("seq").collect()]


def test_epoch_policy(spark):
    still = (0.0, 0.0, 0.5, None, 0.0, False, None)
    assert decisions(spark, still, (20.0, *still[1:]))[1] == ("Segment", None)
    assert decisions(spark, still, (2.0, *still[1:]))[1] == ("Degrade", "PtzMoving")
    assert decisions(spark, still, (20.0, 0.0, 0.5, 0.9, 0.0, False, None))[1] == ("Compensate", "PtzMoving")
    assert decisions(spark, still, (0.005, *still[1:]))[1] == ("Continue", None)
    assert decisions(spark, (None, None, None, None, 0.0, True, None))[0] == ("Segment", None)
    assert decisions(spark, (None, None, None, 0.6, 0.4, False, None))[0] == ("Segment", None)
    assert decisions(spark, (None, None, None, 0.6, 0.1, False, None))[0] == ("Degrade", "InferredMotionLowConfidence")


def test_phases_cycle(spark):
    hints = ["Stable", "Moving", "Moving", "Stable", "Stable"]
    rows = view.decided(reports(spark, [(None, None, None, None, 0.0, False, h) for h in hints]))
    assert [r.p for r in rows.select("seq", view.phase().alias("p")).orderBy("seq").collect()] == ["Settled", "MoveStart", "Moving", "MoveEnd", "Settled"]
    assert [round(r.stability, 6) for r in view.stability(rows).orderBy("seq").collect()] == [0.1, 0.1, 0.1, 0.2, 0.3]


def points(spark, rows):
    return spark.createDataFrame([(1, 1, k, *r) for k, r in enumerate(rows)], "feed_id long, track_id long, seq long, ts_ns long, x double, y double, state string, epoch long")


def test_motion_golden(spark):
    m = trajectory.motion(trajectory.segmented(points(spark, [(0, 0.0, 0.0, "Confirmed", 0), (10**9, 0.5, 0.0, "Confirmed", 0)]))).first()
    assert (m.displacement, m.net_displacement, m.mean_speed, m.max_speed, m.direction, m.is_stationary) == (0.5, 0.5, 0.5, 0.5, 0.0, False)
    single = trajectory.motion(trajectory.segmented(points(spark, [(0, 0.0, 0.0, "Confirmed", 0)]))).first()
    assert (single.displacement, single.direction, single.is_stationary) == (0.0, None, True)


def test_segments_end_with_lost(spark):
    rows = [(k, 0.1 * k, 0.0, "Lost" if k == 3 else "Confirmed", k // 2) for k in range(6)]
    seg = trajectory.bounds(trajectory.segmented(points(spark, rows))).orderBy("segment").collect()
    assert [(r.opened_by, r.closed_by) for r in seg] == [("TrackCreated", "EpochChange:0>1"), ("EpochChange:0>1", "TrackLost")]


def test_nms_and_greedy(spark):
    dets = spark.createDataFrame([(1, 1, k, 0, c, x, 0.0, x + 1, 1.0) for k, (c, x) in enumerate([(0.9, 0.0), (0.8, 0.1), (0.7, 3.0), (0.9, 3.05)])], "feed_id long, seq long, det_id long, class_id long, conf double, x_min double, y_min double, x_max double, y_max double")
    assert sorted(r.det_id for r in association.nms(dets).collect()) == [0, 3]
    pairs = spark.createDataFrame([(1, 1, 1, 1, 0.9), (1, 1, 1, 2, 0.8), (1, 1, 2, 1, 0.85), (1, 1, 2, 2, 0.1)], "feed_id long, seq long, track_id long, det_id long, s double")
    assert sorted((r.track_id, r.det_id) for r in association.greedy(pairs, F.col("s")).collect()) == [(1, 1), (2, 2)]


def test_suppression_of_empty_boxes():
    empty = np.array([(0.1, 0.1, 0.1, 0.3), (0.5, 0.1, 0.5, 0.3)])
    assert [association.suppressed(empty, np.zeros(2), 0.45, guard).tolist() for guard in (True, False)] == [[0, 1], [0]]


def test_tensor_decoding(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0, 1.0, 1.0, 0.9, 2.0, 0.0, 0.0, 1.0, 1.0, 0.1, 2.0, 0.0, 0.0, 1.0, 1.0, float("nan"), 1.0]), (2, [1.0] * 7), (3, [])], "seq long, tensor array<double>")
    got = association.decode_tensor(rows, "tensor", 0.25, 10).collect()
    assert [(r.seq, r.det_id, r.class_id) for r in got] == [(1, 10, 2.0), (1, 11, 1.0)]


def test_vectors_of_any_length_are_decoded_whole(spark):
    rows = spark.createDataFrame([(1, [0.5] * 76), (2, [0.5] * 64), (3, [0.5] * 5), (4, [])], "vec_id long, embedding array<float>")
    got = registry.queries_frames.flt_conf_decode(SimpleNamespace(embeddings=rows)).groupBy("vec_id").count().collect()
    assert sorted(map(tuple, got)) == [(1, 12), (2, 10)]


def boxes(*rows):
    return np.array(rows, dtype=float), np.zeros(len(rows), int), np.arange(len(rows)), np.full(len(rows), 0.9)


def test_tracker_life():
    t = tracker.Tracker(tracker.Config(output_tentative=True, max_age=4))
    states = [t.update(*boxes([0.1, 0.2, 0.3, 0.4]))[0][2] for _ in range(4)]
    assert states == ["Tentative", "Tentative", "Confirmed", "Confirmed"]
    none = (np.zeros((0, 4)), np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    assert [[o[2] for o in t.update(*none)] for _ in range(5)] == [["Coasted"], ["Coasted"], ["Lost"], ["Lost"], []]
    assert t.update(*boxes([0.1, 0.2, 0.3, 0.4]))[0][0] == 2  # ids go on


def test_frames_without_detections_are_tracked(spark):
    ddl = "feed_id long, seq long, det_id long, class_id long, conf double, x_min double, y_min double, x_max double, y_max double"
    dets = spark.createDataFrame([(1, k, k, 0, 0.9, 0.1, 0.2, 0.3, 0.4) for k in (0, 1, 2, 3, 9, 10)], ddl)
    frames = spark.range(12).select(F.lit(1).cast("long").alias("feed_id"), F.col("id").alias("seq"))
    config = tracker.Config(output_tentative=True, max_age=4)
    shown = lambda f: [(r.seq, r.track_id, r.state) for r in tracker.track(dets, f, config).orderBy("seq").collect()]
    first = [(0, 1, "Tentative"), (1, 1, "Tentative"), (2, 1, "Confirmed"), (3, 1, "Confirmed"), (4, 1, "Coasted"), (5, 1, "Coasted")]
    last = [(9, 2, "Tentative"), (10, 2, "Tentative"), (11, 2, "Coasted")]
    assert shown(frames) == [*first, (6, 1, "Lost"), (7, 1, "Lost"), *last]
    assert shown(frames.withColumn("epoch", F.floor(F.col("seq") / 6))) == [*first, *last]  # it changes on an empty frame


def test_tracker_steps_match_their_formulas():
    rng = np.random.default_rng(3)
    x, p = rng.random((3, 7)), rng.random((3, 7, 7))
    nx, np_ = tracker.predicted(x, p)
    for n in range(3):
        want = p[n].copy()
        for i in range(3):
            for j in range(7):
                vj = j + 4 if j < 3 else j
                want[i, j] += p[n, i + 4, j] + p[n, i, vj] + p[n, i + 4, vj]
        want += np.diag([abs(nx[n, 2]) * (1 / 400 if k < 4 else 1 / 25600) for k in range(7)])
        assert np.allclose(np_[n], want)
    z = rng.random((3, 4))
    cx, cp = tracker.corrected(x, p, z)
    for n in range(3):
        s = p[n, :4, :4] + abs(x[n, 2]) / 400 * np.eye(4)
        k = p[n, :, :4] @ np.linalg.inv(s)
        want = p[n].copy()
        for i in range(7):
            for j in range(4):
                want[i, j] -= k[i, j] * p[n, j, j]
        assert np.allclose(cp[n], want) and np.allclose(cx[n], x[n] + k @ (z[n] - x[n, :4]))


def test_store_rules():
    s = store.TrackStore(store.Retention(max_tracks=2, lost_age_ns=100))
    assert s.commit(1, 0, "Confirmed", 0, 1) == (True, None) and s.commit(2, 1, "Tentative", 0, 2) == (True, None)
    assert s.commit(3, 2, "Confirmed", 0, 3) == (True, 2)
    assert s.commit(4, 3, "Confirmed", 0, 4) == (False, None)
    s.commit(1, 4, "Lost", 0, 5)
    assert s.retain(50) == [] and s.retain(104) == [1] and s.end_absent({9}) == [3]


def test_retention_with_more_tracks_than_the_cap(spark):
    ids = spark.range(502)  # the first goes for the 501st; for the 502nd none may go
    state = F.when(F.col("id") == 0, "Tentative").otherwise("Confirmed")
    rows = ids.select(F.lit(1).cast("long").alias("feed_id"), F.col("id").alias("seq"), F.col("id").alias("track_id"), F.col("id").alias("det_id"), F.col("id").alias("ts_ns"), state.alias("state"), F.lit(0).cast("long").alias("epoch"))
    got = registry.queries_tracks.st_retention(SimpleNamespace(track_points=rows)).collect()
    assert len(got) == 502 and sorted(r.track_id for r in got if not r.kept) == [0, 501]
    few = store.retained(rows, store.Retention(max_tracks=2, lost_age_ns=100)).filter("kept").collect()
    assert sorted((r.track_id, r.n_observations, r.n_points) for r in few) == [(1, 1, 1), (2, 1, 1)]


def arrivals(spark, rows):
    return spark.createDataFrame([(1, k, a, s) for k, (a, s) in enumerate(rows)], "feed_id long, seq long, arrival_ns long, service_ns long")


def test_queue_policies(spark):
    rows = [(k, 100) for k in range(6)]
    dropped = lambda policy: sorted(r.seq for r in flow.queued(arrivals(spark, rows), 2, policy).filter("dropped").collect())
    assert dropped("DropOldest") == [1, 2, 3] and dropped("DropNewest") == [3, 4, 5] and dropped("Block") == []
    with pytest.raises(ValueError):
        flow.queued(arrivals(spark, rows), 0)


def test_sampling_at_a_target_rate(spark):
    frames = spark.range(90).select(F.lit(1).cast("long").alias("feed_id"), F.col("id").alias("seq"), (F.col("id") * 33_333_333).alias("ts_ns"))
    got = flow.to_target_fps(frames, 5.0, 0)
    assert got.select("interval").distinct().first()[0] == 6 and got.filter("included").count() == 10
    assert frames.withColumn("k", flow.sampled(6)).filter("seq < 30 AND k").count() == 5


def test_throttle_adds_up(spark):
    rows = [(1, k * 300_000_000, k, k % 10 != 9, 2) for k in range(25)]
    df = spark.createDataFrame(rows, "feed_id long, ts_ns long, event_id long, bad boolean, delta long")
    assert sum(r.n for r in flow.coalesced(df).collect()) == 2 * sum(r[3] for r in rows)


def test_pipeline_checks(spark):
    p = Pipeline().add(Stage("track", lambda d: d, frozenset({"detections"}), frozenset({"tracks"}))).add(Stage("track", lambda d: d))
    assert len(p.problems()) == 2
    with pytest.raises(ValueError):
        p.run(spark.range(1))
    with pytest.raises(ValueError):
        Pipeline().with_batch(Stage("a", lambda d: d)).with_batch(Stage("b", lambda d: d))
    assert FeedConfig().problems()[:1] == ["source is missing"]
    ok = FeedConfig("rtsp://h", "Observed", p, print, object())
    assert ok.problems() == [] and FeedConfig("rtsp://h", "Observed", p, print, object(), require_tls=True).problems() == ["the source is not encrypted"]
    with pytest.raises(PermissionError):
        media.custom_frames(spark, "rate", {})


def test_merge_replaces_and_appends(spark):
    rows = [(1, 1, 1, 5, None, ["a"], ["x"], {"k": "1", "m": "1"}), (1, 1, 2, None, None, ["b"], ["y", "x"], {"k": "2"}), (1, 2, 1, None, 7, None, None, None)]
    df = spark.createDataFrame(rows, "feed_id long, seq long, stage_no long, detections long, tracks long, signals array<string>, scene_features array<string>, artifacts map<string,string>")
    a, b = merged(df).orderBy("seq").collect()
    assert (a.detections, a.tracks, a.authoritative, a.signals, a.artifacts) == (5, None, False, ["a", "b"], {"k": "2", "m": "1"})
    assert a.scene_features == ["x", "y", "x"]
    assert (b.tracks, b.authoritative, b.signals, b.scene_features, b.artifacts) == (7, True, [], [], {})


def test_batch_measures(spark):
    """Pending is what was neither processed nor rejected; rates are of all that was submitted, and null over nothing."""
    rows = [("p", 1, 4, True, 6, 1, 2, 8_000_000, 2_000_000), ("p", 2, 2, False, 3, 0, 0, 4_000_000, 0), ("q", 1, 1, True, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "processor_id string, dispatch_id long, size long, ok boolean, submitted long, rejected long, timed_out long, processing_ns long, formation_ns long")
    m = metrics.batch_metrics(df, 4)
    p, q = m.orderBy("processor_id").collect()
    assert (p.items, p.submitted, p.pending_items, p.consecutive_errors, p.rejection_rate, p.timeout_rate) == (6, 9, 2, 1, 1 / 9, 2 / 9)
    assert (q.pending_items, q.rejection_rate, q.timeout_rate) == (0, None, None)
    got = {(r.subject, r.gauge): r.value for r in metrics.batch_gauges(m).collect()}
    assert len(got) == 2 * len(metrics.GAUGES["batch"])
    assert (got["p", "batch.avg_processing_ms"], got["p", "batch.avg_fill_ratio"], got["p", "batch.pending_items"]) == (6.0, 0.75, 2.0)


def test_counted_events_and_status(spark):
    kinds = ["SourceConnected", "ViewDegraded", "ViewDegraded", "FrameLag", "SourceEos", "FeedRestarting"]
    events = spark.createDataFrame([(1, k, 5) for k in kinds], "feed_id long, kind string, delta long")
    assert {r.kind: r.n for r in metrics.health_counters(events).collect()} == {"ViewDegraded": 2, "FrameLag": 5, "FeedRestarting": 1}
    frames = spark.createDataFrame([(f, 1, 0, False, 3) for f in (1, 2)], "feed_id long, seq long, epoch long, dropped boolean, tracks long")
    assert {r.feed_id: r.restarts for r in metrics.feed_metrics(frames, events).collect()} == {1: 1, 2: 0}
    states = spark.createDataFrame([("Stable",), ("Degraded",), ("Invalid",), ("other",)], "s string")
    assert [r[0] for r in states.select(metrics.status_number(F.col("s"))).collect()] == [0, 1, 2, None]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 3, k, k * 7_000_000, 5_000_000) for k in range(300)]
    ddl = "feed_id long, seq long, arrival_ns long, service_ns long"
    df = spark.createDataFrame(rows, ddl)
    for k in range(3):  # files in order of time
        df.filter(F.floor(F.col("seq") / 100) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = "feed_id long, seq long, batch_id long, place long"
    folded = fold_stream(stream, ["feed_id"], ["arrival_ns", "seq"], lambda: flow.Batcher(4, 50_000_000), flow.Batcher.add, out)
    seen = [[], []]
    sinks = [lambda b, _, s=s: s.extend(map(tuple, b.collect())) for s in seen]
    fan_out(folded, sinks, str(tmp_path / "cp")).awaitTermination(120)
    want = sorted(map(tuple, flow.batched(df, 4, 50_000_000).collect()))
    assert sorted(seen[0]) == want and sorted(seen[1]) == want


DAY = 86_400 * 10**9  # a watermark begins at 0, so rows do not
ENDED = {
    "queue": (lambda: flow.Queue(2), flow.Queue.push, flow.QUEUED, flow.Queue.close, lambda df: flow.queued(df, 2)),
    "throttle": (flow.Throttle, flow.Throttle.see, flow.COALESCED, flow.Throttle.stop, flow.coalesced),
    "coordinator": (
        lambda: flow.Coordinator(2, 3, 50_000_000, 12, 60_000_000), flow.Coordinator.submit, "feed_id long, seq long, outcome string", flow.Coordinator.close,
        lambda df: flow.submitted(df, 2, 3, 50_000_000, 12, 10_000_000),
    ),
}


@pytest.mark.parametrize("name", sorted(ENDED))
def test_stream_with_an_end_equals_batch(spark, tmp_path, name):
    """Rows that wait at the end come out once the watermark has passed; a feed idle for long is finished."""
    start, step, out, finish, batch = ENDED[name]
    ddl = "feed_id long, seq long, event_id long, processor_id long, arrival_ns long, ts_ns long, service_ns long, bad boolean, delta long"
    rows = [(k % 3, k, k, k % 3, DAY + k * 7_000_000, DAY + k * 7_000_000, 30_000_000, k % 50 > 10 or k > 290, 1) for k in range(300)]
    df = spark.createDataFrame(rows, ddl)
    clock = spark.createDataFrame([(99, 10**6 + k, 10**6 + k, 99, DAY * t, DAY * t, 1, False, 0) for k, t in enumerate((2, 3, 4))], ddl)
    for k in range(3):  # files in order of time, then rows of another feed that move the watermark
        df.filter(F.floor(F.col("seq") / 100) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for k in range(3):
        clock.filter(F.col("seq") == 10**6 + k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("at", F.timestamp_micros(F.floor(F.col("ts_ns") / 1000)))
    order = ["ts_ns", "event_id"] if name == "throttle" else ["arrival_ns", "seq"]
    folded = fold_stream(stream, ["feed_id"], order, start, step, out, finish, "at")
    seen = []
    fan_out(folded, [lambda b, _: seen.extend(map(tuple, b.collect()))], str(tmp_path / "cp")).awaitTermination(120)
    want = sorted(map(str, map(tuple, batch(df).collect())))
    assert sorted(str(r) for r in seen if r[0] != 99) == want and want


def test_stream_leaves_out_late_rows(spark, tmp_path):
    ddl = "feed_id long, seq long, arrival_ns long, service_ns long"
    for k, t in enumerate((0, 100, 200, 5, 300)):  # seconds; the fourth is behind the watermark
        spark.createDataFrame([(1, k, DAY + t * 10**9, 1)], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream.withColumn("at", F.timestamp_micros(F.floor(F.col("arrival_ns") / 1000)))
    folded = fold_stream(stream, ["feed_id"], ["arrival_ns"], flow.Queue, flow.Queue.push, flow.QUEUED, flow.Queue.close, "at", idle_ms=10**9)
    seen = []
    fan_out(folded, [lambda b, _: seen.extend(r.seq for r in b.collect())], str(tmp_path / "cp")).awaitTermination(120)
    assert seen == [0, 1, 2, 4]


def test_compensation_is_one_transform_after_the_other(spark):
    """A zoom, then a turn, then a shift, of points of two segments."""
    points = spark.createDataFrame([(1, 1, s, s, float(s), 2.0, "Confirmed", 0 if s < 6 else 1) for s in range(8)], "feed_id long, track_id long, seq long, ts_ns long, x double, y double, state string, epoch long")
    moves = {1: (2.0, 0.0, 0.0, 0.0, 2.0, 0.0), 3: (0.0, -1.0, 0.5, 1.0, 0.0, 0.0), 5: (1.0, 0.2, 0.1, 0.0, 1.0, -0.3), 7: (0.5, 0.0, 0.0, 0.0, 0.5, 1.0)}
    shifts = spark.createDataFrame([(1, s, *m) for s, m in moves.items()], "feed_id long, seq long, a double, b double, tx double, c double, d double, ty double")
    got = {r.seq: r for r in trajectory.compensated(trajectory.segmented(points), shifts).collect()}
    for s in range(8):
        x, y, n = float(s), 2.0, 0
        for at, (a, b, tx, c, d, ty) in moves.items():
            if s < at <= (5 if s < 6 else 7):
                x, y, n = a * x + b * y + tx, c * x + d * y + ty, n + 1
        assert got[s].n_compensations == n and abs(got[s].x - x) < 1e-9 and abs(got[s].y - y) < 1e-9


def test_in_flight_cap(spark):
    got = flow.submitted(arrivals(spark, [(0, 10), (5, 10), (10, 10), (12, 1), (25, 1)])).orderBy("seq").collect()
    assert [r.outcome for r in got] == ["Accepted", "InFlightCapReached", "Accepted", "InFlightCapReached", "Accepted"]


def test_shared_queue_and_timeouts(spark):
    s = 1_000_000_000
    ddl = "feed_id long, seq long, arrival_ns long, service_ns long"
    outcomes = lambda rows, **k: [r.outcome for r in flow.submitted(spark.createDataFrame(rows, ddl), **k).orderBy("feed_id", "seq").collect()]
    # one item at work, four in the queue, no place for the sixth feed's until the first is answered
    assert outcomes([(f, 0, f, 10) for f in range(6)]) == ["Accepted"] * 5 + ["QueueFull"]
    assert outcomes([*[(f, 0, f, 10) for f in range(5)], (5, 0, 10, 10)]) == ["Accepted"] * 6
    # a batch is answered with its slowest item; what times out stays in flight
    assert outcomes([(1, 0, 0, 6 * s), (1, 1, 5 * s, 1), (1, 2, 6 * s, 1)]) == ["Timeout", "InFlightCapReached", "Accepted"]
    assert outcomes([(1, 0, 0, 5 * s), (2, 0, 1, 1), (3, 0, 2, 1)], size=2, latency_ns=10) == ["Accepted", "Accepted", "Accepted"]
    assert outcomes([(1, 0, 0, 5 * s), (2, 0, 1, 6 * s), (3, 0, 2, 1)], size=2, latency_ns=10) == ["Timeout", "Timeout", "Timeout"]
    # a batch that is not full waits for its latency
    assert outcomes([(1, 0, 0, 5), (1, 1, 14, 1), (1, 2, 15, 1)], size=2, latency_ns=10) == ["Accepted", "InFlightCapReached", "Accepted"]
    with pytest.raises(ValueError):
        flow.submitted(spark.createDataFrame([(1, 0, 0, 1)], ddl), size=8, capacity=4)


def test_source_states(spark):
    kinds = ["StreamStarted", "Error", "Error", "StreamStarted", "Pause", "Resume", "Eos", "StreamStarted"]
    rows = spark.createDataFrame([(1, k, k, kind, False) for k, kind in enumerate(kinds)], "feed_id long, ts_ns long, event_id long, kind string, loops boolean")
    got = flow.source_states(rows).orderBy("event_id").collect()
    assert [r.state for r in got] == ["Running", "Reconnecting", "Reconnecting", "Running", "Paused", "Running", "Stopped", "Stopped"]
    assert [r.attempts for r in got][:4] == [0, 1, 2, 0]
    assert flow.source_states(rows, 1).orderBy("event_id").collect()[2].state == "Stopped"


def test_restarts(spark):
    rows = spark.createDataFrame([(1, k, u, "Stage") for k, u in enumerate([1, 1, 1, 1, 1, 1, 300_000_000_000, 1])], "feed_id long, seq long, uptime_ns long, fault string")
    assert [(r.restarted, r.restarts) for r in flow.restarts(rows).orderBy("seq").collect()] == [(True, 1), (True, 2), (True, 3), (True, 4), (True, 5), (False, 5), (True, 1), (True, 2)]
    assert not any(r.restarted for r in flow.restarts(rows, "SourceFailure").collect())


def test_declared_stages_and_batch_limits(spark):
    rows = [(1, 1, "a", ["tracks"], ["detections"]), (1, 2, "b", ["detections", "tracks"], ["tracks"]), (1, 3, "a", ["tracks"], None), (2, 1, "a", None, [])]
    table = spark.createDataFrame(rows, "pipeline_id long, stage_no long, stage_id string, consumes array<string>, produces array<string>")
    found = sorted((r.pipeline_id, r.stage_no, r.problem) for r in declared_problems(table).collect())
    assert found == [(1, 1, "needs tracks"), (1, 2, "needs tracks"), (1, 3, "appears twice")]
    assert FeedConfig(sink_capacity=0).sink_depth() == 1
    limits = [BatchConfig(), BatchConfig(0, 0, 0), BatchConfig(queue_capacity=3), BatchConfig(response_timeout_ns=0, startup_timeout_ns=0)]
    table = spark.createDataFrame([tuple(vars(c).values()) for c in limits], "size long, latency_ns long, in_flight long, queue_capacity long, response_timeout_ns long, startup_timeout_ns long")
    assert [sorted(r[0]) for r in table.select(batch_problems(table)).collect()] == [sorted(c.problems()) for c in limits]
