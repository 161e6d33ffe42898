"""Queries of single rows: geometry, clocks, text, pixels and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frameloom.functions import clock, pixels, text
from frameloom.functions.geometry import Box, affine_point, affine_then, angular_delta, clamp_unit, direction_penalty, distance
from frameloom.registry import query
from frameloom.sources import media

KEYS = ("feed_id", "seq", "det_id")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


@query("geo_wh_area", "SELECT feed_id, seq, det_id, round(x_max - x_min, 6) AS width, round(y_max - y_min, 6) AS height, round((x_max - x_min) * (y_max - y_min), 6) AS area FROM detections")
def geo_wh_area(t):
    b = Box.of()
    return t.detections.select(*KEYS, r6(b.width, "width"), r6(b.height, "height"), r6(b.area, "area"))


@query("geo_center", "SELECT feed_id, seq, det_id, round((x_min + x_max) * 0.5e0, 6) AS cx, round((y_min + y_max) * 0.5e0, 6) AS cy FROM detections")
def geo_center(t):
    x, y = Box.of().center
    return t.detections.select(*KEYS, r6(x, "cx"), r6(y, "cy"))


IOU_SQL = """WITH i AS (SELECT *, greatest(least(ax1, bx1) - greatest(ax0, bx0), 0e0) * greatest(least(ay1, by1) - greatest(ay0, by0), 0e0) AS inter FROM frame_pairs),
u AS (SELECT *, (ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - inter AS uni FROM i)
"""
A, B = ("ax0", "ay0", "ax1", "ay1"), ("bx0", "by0", "bx1", "by1")


@query("geo_iou", IOU_SQL + "SELECT feed_id, seq, track_id, det_id, round(CASE WHEN uni > 0 THEN inter / uni ELSE 0e0 END, 6) AS iou FROM u")
def geo_iou(t):
    return t.frame_pairs.select("feed_id", "seq", "track_id", "det_id", r6(Box.of(*A).iou(Box.of(*B)), "iou"))


@query("geo_distance", "SELECT feed_id, seq, track_id, det_id, round(sqrt((bx0 - ax0) * (bx0 - ax0) + (by0 - ay0) * (by0 - ay0)), 6) AS distance FROM frame_pairs")
def geo_distance(t):
    return t.frame_pairs.select("feed_id", "seq", "track_id", "det_id", r6(distance(*map(F.col, ("ax0", "ay0", "bx0", "by0"))), "distance"))


def matrix(*values):
    return [v if not isinstance(v, float) else F.lit(v) for v in values]


M = (0.9, -0.1, 0.05, 0.1, 0.9, -0.02)


@query("geo_affine_point", "SELECT feed_id, seq, det_id, round(0.9e0 * x_min - 0.1e0 * y_min + 0.05e0, 6) AS px, round(0.1e0 * x_min + 0.9e0 * y_min - 0.02e0, 6) AS py FROM detections")
def geo_affine_point(t):
    x, y = affine_point(matrix(*M), F.col("x_min"), F.col("y_min"))
    return t.detections.select(*KEYS, r6(x, "px"), r6(y, "py"))


@query(
    "geo_affine_bbox",
    """WITH c AS (SELECT feed_id, seq, det_id, 0.9e0 * x - 0.1e0 * y + 0.05e0 AS px, 0.1e0 * x + 0.9e0 * y - 0.02e0 AS py
FROM (SELECT feed_id, seq, det_id, unnest([x_min, x_min, x_max, x_max]) AS x, unnest([y_min, y_max, y_min, y_max]) AS y FROM detections))
SELECT feed_id, seq, det_id, round(min(px), 6) + 0e0 AS x0, round(min(py), 6) + 0e0 AS y0, round(max(px), 6) AS x1, round(max(py), 6) AS y1 FROM c GROUP BY ALL""",
)
def geo_affine_bbox(t):
    b = Box.of().transformed(matrix(*M))
    return t.detections.select(*KEYS, (F.round(b.x0, 6) + 0.0).alias("x0"), (F.round(b.y0, 6) + 0.0).alias("y0"), r6(b.x1, "x1"), r6(b.y1, "y1"))


@query(
    "geo_affine_then",
    """SELECT feed_id, seq, round(0.9e0 * (1 + disp) - 0.1e0 * disp, 6) AS a, round(0.9e0 * disp - 0.1e0 * (1 - disp), 6) AS b,
round(0.9e0 * disp - 0.1e0 * disp / 2 + 0.05e0, 6) AS tx, round(0.1e0 * (1 + disp) + 0.9e0 * disp, 6) AS c, round(0.1e0 * disp + 0.9e0 * (1 - disp), 6) AS d,
round(0.1e0 * disp + 0.9e0 * disp / 2 - 0.02e0, 6) AS ty FROM reports""",
)
def geo_affine_then(t):
    d = F.col("disp")
    out = affine_then([1 + d, d, d, d, 1 - d, d / 2], matrix(*M))
    return t.reports.select("feed_id", "seq", *[r6(c, n) for c, n in zip(out, ("a", "b", "tx", "c", "d", "ty"), strict=True)])


@query("geo_disp_mag", "SELECT feed_id, seq, round(sqrt(disp * disp + conf * conf), 6) AS magnitude FROM reports")
def geo_disp_mag(t):
    return t.reports.select("feed_id", "seq", r6(F.sqrt(F.col("disp") * F.col("disp") + F.col("conf") * F.col("conf")), "magnitude"))


@query("geo_angular_delta", "SELECT feed_id, seq, round(least(abs(pan * 17 - tilt), 360e0 - abs(pan * 17 - tilt)), 6) AS delta FROM reports WHERE pan IS NOT NULL")
def geo_angular_delta(t):
    return t.reports.filter("pan IS NOT NULL").select("feed_id", "seq", r6(angular_delta(F.col("pan") * 17, F.col("tilt")), "delta"))


@query(
    "sc_clamp_unit",
    """WITH v AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE ELSE value / 50 - 1 END AS x FROM events)
SELECT event_id, round(CASE WHEN isnan(x) OR isinf(x) THEN 0e0 ELSE greatest(0e0, least(1e0, x)) END, 6) AS clamped FROM v""",
)
def sc_clamp_unit(t):
    k = F.col("event_id") % 7
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("value") / 50 - 1)
    return t.events.select("event_id", r6(clamp_unit(x), "clamped"))


@query(
    "ts_ops",
    """WITH l AS (SELECT feed_id, seq, arrival_ns, service_ns, lag(arrival_ns + service_ns) OVER (PARTITION BY feed_id ORDER BY seq) AS free_ns FROM arrivals)
SELECT feed_id, seq, CASE WHEN arrival_ns >= free_ns THEN arrival_ns - free_ns END AS idle_ns, greatest(arrival_ns - free_ns, 0) AS idle_or_zero,
round(service_ns / 1e9, 6) AS service_s, arrival_ns + service_ns AS done_ns,
CASE WHEN service_ns >= 1000000000 THEN printf('%.3fs', service_ns / 1e9) WHEN service_ns >= 1000000 THEN printf('%.3fms', service_ns / 1e6)
WHEN service_ns >= 1000 THEN printf('%.1fμs', service_ns / 1e3) ELSE printf('%dns', service_ns) END AS service_text FROM l""",
)
def ts_ops(t):
    free = F.lag(F.col("arrival_ns") + F.col("service_ns")).over(Window.partitionBy("feed_id").orderBy("seq"))
    rows = t.arrivals.withColumn("free_ns", free)
    a, s, f = map(F.col, ("arrival_ns", "service_ns", "free_ns"))
    zero = F.when(f.isNotNull(), clock.since_or_zero(a, f)).otherwise(F.lit(0).cast("long"))
    return rows.select("feed_id", "seq", clock.since(a, f).alias("idle_ns"), zero.alias("idle_or_zero"), r6(clock.seconds(s), "service_s"), (a + s).alias("done_ns"), clock.pretty(s).alias("service_text"))


@query("id_display", "SELECT feed_id, seq, track_id, 'feed-' || feed_id AS feed, 'track-' || track_id AS track, 'det-' || det_id AS det, 'epoch-' || seq AS epoch, 'v' || seq AS version FROM observations")
def id_display(t):
    named = {"feed": ("feed-", "feed_id"), "track": ("track-", "track_id"), "det": ("det-", "det_id"), "epoch": ("epoch-", "seq"), "version": ("v", "seq")}
    return t.observations.select("feed_id", "seq", "track_id", *[clock.display(p, F.col(c)).alias(n) for n, (p, c) in named.items()])


@query("px_convert", "SELECT event_id, cast(floor((event_id % 256) * 0.299e0 + (event_id * 7 % 256) * 0.587e0 + (event_id * 13 % 256) * 0.114e0 + 0.5e0) AS bigint) AS gray FROM events")
def px_convert(t):
    e = F.col("event_id")
    return t.events.select("event_id", pixels.luma(e % 256, e * 7 % 256, e * 13 % 256).alias("gray"))


BOX_SQL = """WITH p AS (SELECT o_orderkey, 320e0 + o_custkey % 1600 AS w, 240e0 + o_orderkey % 840 AS h FROM orders), q AS (SELECT *, least(640e0 / w, 640e0 / h) AS scale FROM p),
z AS (SELECT *, cast(floor(w * scale + 0.5e0) AS bigint) AS new_w, cast(floor(h * scale + 0.5e0) AS bigint) AS new_h FROM q)
"""


def sized(t):
    w, h = (F.col("o_custkey") % 1600).cast("double") + 320, (F.col("o_orderkey") % 840).cast("double") + 240
    return t.orders.select("o_orderkey", w.alias("w"), h.alias("h"))


@query("px_letterbox", BOX_SQL + "SELECT o_orderkey, round(scale, 6) AS scale, new_w, new_h, round((640 - new_w) / 2e0, 6) AS pad_x, round((640 - new_h) / 2e0, 6) AS pad_y FROM z")
def px_letterbox(t):
    p = pixels.letterbox(F.col("w"), F.col("h"), 640)
    return sized(t).select("o_orderkey", r6(p["scale"], "scale"), p["new_w"].alias("new_w"), p["new_h"].alias("new_h"), r6(p["pad_x"], "pad_x"), r6(p["pad_y"], "pad_y"))


@query("px_remap", BOX_SQL + "SELECT o_orderkey, round(greatest(0e0, least((o_orderkey % 700 - (640 - new_w) / 2e0) / scale, w)) / w + 1e-9, 6) AS x, round(greatest(0e0, least((o_orderkey % 650 - (640 - new_h) / 2e0) / scale, h)) / h + 1e-9, 6) AS y FROM z")
def px_remap(t):
    p = pixels.letterbox(F.col("w"), F.col("h"), 640)
    x = pixels.remap(F.col("o_orderkey") % 700, p["pad_x"], p["scale"], F.col("w"))
    y = pixels.remap(F.col("o_orderkey") % 650, p["pad_y"], p["scale"], F.col("h"))
    return sized(t).select("o_orderkey", r6(x + 1e-9, "x"), r6(y + 1e-9, "y"))


@query("cls_format_ok", "SELECT p_partkey, f AS format, cast(CASE f WHEN 'Rgb8' THEN 3 WHEN 'Rgba8' THEN 4 END AS bigint) AS bytes_per_pixel FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Rgb8' WHEN 1 THEN 'Rgba8' WHEN 2 THEN 'Nv12' ELSE 'Gray8' END AS f FROM part)")
def cls_format_ok(t):
    k = F.col("p_size") % 4
    f = F.when(k == 0, "Rgb8").when(k == 1, "Rgba8").when(k == 2, "Nv12").otherwise("Gray8")
    size = F.when(f == "Rgb8", 3).when(f == "Rgba8", 4).cast("long")
    return t.part.select("p_partkey", f.alias("format"), size.alias("bytes_per_pixel"))


@query("flt_insecure", "SELECT page_id, source_url LIKE 'rtsp://%' AS insecure FROM source_urls")
def flt_insecure(t):
    return t.source_urls.select("page_id", text.is_insecure(F.col("source_url")).alias("insecure"))


@query("str_redact_url", r"SELECT page_id, CASE WHEN instr(source_url, '://') > 0 THEN regexp_replace(source_url, '^(.*?://)[^/]*@', '\1***@') ELSE regexp_replace(source_url, '^[^/]*@', '***@') END AS url FROM source_urls")
def str_redact_url(t):
    return t.source_urls.select("page_id", text.redact_url(F.col("source_url")).alias("url"))


@query("str_redact_urls", r"""SELECT conv_id, turn, regexp_replace(line, '((?:rtsps?|https?)://)[^/\s''">)]*@', '\1***@', 'g') AS line FROM log_lines""")
def str_redact_urls(t):
    return t.log_lines.select("conv_id", "turn", text.redact_urls(F.col("line")).alias("line"))


def sanitize_sql() -> str:
    out = "cut"
    for name in text.SECRET_NAMES:
        out = f"regexp_replace({out}, '(?i)({name})[^{text.VALUE_ENDS.replace(chr(39), chr(39) * 2)}]+', '\\1***', 'g')"
    return f"""WITH c AS (SELECT conv_id, turn, regexp_replace(line, '\\p{{Cc}}', ' ', 'g') AS clean FROM log_lines),
k AS (SELECT *, CASE WHEN strlen(clean) > {text.LINE_LIMIT} THEN substr(clean, 1, list_min(list_filter(range({text.LINE_LIMIT // 4}, {text.LINE_LIMIT + 1}), lambda n: strlen(substr(clean, 1, n)) >= {text.LINE_LIMIT}))) || '...[truncated]' ELSE clean END AS cut FROM c)
SELECT conv_id, turn, {out} AS line FROM k"""


@query("str_sanitize", sanitize_sql())
def str_sanitize(t):
    return t.log_lines.select("conv_id", "turn", text.sanitize(F.col("line")).alias("line"))


@query("str_promote_tls", "SELECT page_id, CASE WHEN source_url LIKE 'rtsp://%' THEN 'rtsps://' || substr(source_url, 8) WHEN instr(source_url, '://') > 0 THEN source_url ELSE 'rtsps://' || source_url END AS url FROM source_urls")
def str_promote_tls(t):
    return t.source_urls.select("page_id", text.promote_tls(F.col("source_url")).alias("url"))


@query("src_rtsp", "SELECT page_id, CASE WHEN source_url LIKE 'rtsp://%' THEN 'AllowInsecure' ELSE 'PreferTls' END AS tls FROM source_urls")
def src_rtsp(t):
    return t.source_urls.select("page_id", F.when(text.is_insecure(F.col("source_url")), "AllowInsecure").otherwise("PreferTls").alias("tls"))


@query("src_file", "SELECT event_id, user_id, event_type FROM events")
def src_file(t):
    return media.file_frames(t.spark, f"{t.sf_dir}/events.parquet").select("event_id", "user_id", "event_type")


@query("src_bridge", "SELECT feed_id, seq, coalesce(ts_ns, 0) AS ts_ns, cast(row_number() OVER (PARTITION BY feed_id ORDER BY ts_ns, event_id) AS bigint) - 1 AS frame_seq FROM observations")
def src_bridge(t):
    nth = F.row_number().over(Window.partitionBy("feed_id").orderBy("ts_ns", "event_id")).cast("long") - 1
    return t.observations.select("feed_id", "seq", F.coalesce("ts_ns", F.lit(0)).alias("ts_ns"), nth.alias("frame_seq"))


@query("src_host_fallback", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'borrowed' WHEN 1 THEN 'materialized' ELSE 'error' END AS host FROM part")
def src_host_fallback(t):
    access = F.element_at(F.array(*map(F.lit, ("HostReadable", "MappableToHost", "Opaque"))), (F.col("p_size") % 3 + 1).cast("int"))
    host = F.when(access == "HostReadable", "borrowed").when(access == "MappableToHost", "materialized").otherwise("error")
    return t.part.select("p_partkey", host.alias("host"))


@query(
    "src_reconnect",
    """WITH a AS (SELECT feed_id, seq, sum(CASE WHEN NOT ok THEN 0 ELSE 1 END) OVER (PARTITION BY feed_id ORDER BY seq) AS runs, ok FROM (SELECT feed_id, seq, k % 6 = 0 AS ok FROM reports)),
n AS (SELECT feed_id, seq, ok, count(*) OVER (PARTITION BY feed_id, runs ORDER BY seq) - (CASE WHEN runs = 0 THEN 1 ELSE 2 END) AS attempt FROM a)
SELECT feed_id, seq, attempt, cast(least(pow(2e0, attempt) * 1000, 30000e0) AS bigint) AS exponential_ms, cast(least((attempt + 1e0) * 1000, 30000e0) AS bigint) AS linear_ms FROM n WHERE NOT ok""",
)
def src_reconnect(t):
    rows = media.failure_runs(t.reports.select("feed_id", "seq", (F.col("k") % 6 == 0).alias("ok"))).filter("NOT ok")
    attempt = F.col("failures") - 1
    return rows.select("feed_id", "seq", attempt.alias("attempt"), media.backoff(attempt, "Exponential").alias("exponential_ms"), media.backoff(attempt, "Linear").alias("linear_ms"))


@query("src_liveness", "SELECT * FROM (SELECT feed_id, seq, lead(ts_ns) OVER (PARTITION BY feed_id ORDER BY seq) - ts_ns AS gap_ns FROM observations) WHERE gap_ns > 10000000000")
def src_liveness(t):
    return media.silences(t.observations, ("seq",)).select("feed_id", "seq", "gap_ns")


@query("src_pts", "WITH j AS (SELECT feed_id, seq, abs(ts_ns - lag(ts_ns) OVER (PARTITION BY feed_id ORDER BY event_id)) AS jump FROM observations) SELECT feed_id, seq, CASE WHEN jump IS NULL THEN 'First' WHEN jump > 5000000000 THEN 'Discontinuity' ELSE 'Normal' END AS kind FROM j")
def src_pts(t):
    return t.observations.select("feed_id", "seq", media.pts_kind(F.col("ts_ns"), ("event_id",)).alias("kind"))


DECODERS = """(SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'Auto' WHEN 1 THEN 'CpuOnly' WHEN 2 THEN 'PreferHardware' ELSE 'RequireHardware' END AS pref,
CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 3 = 0 END AS hw FROM part)"""


@query("src_decode_pref", f"SELECT p_partkey, CASE WHEN pref = 'RequireHardware' AND NOT coalesce(hw, false) THEN 'Rejected' WHEN hw IS NULL THEN 'Unknown' WHEN hw THEN 'Hardware' ELSE 'Software' END AS outcome FROM {DECODERS}")
def src_decode_pref(t):
    k = F.col("p_size") % 4
    pref = F.when(k == 0, "Auto").when(k == 1, "CpuOnly").when(k == 2, "PreferHardware").otherwise("RequireHardware")
    hw = F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 3 == 0)
    return t.part.select("p_partkey", media.decode_outcome(pref, hw).alias("outcome"))


NAMED = "(SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Codec/Decoder/Video/Hardware' WHEN 1 THEN 'Codec/Decoder/Video' ELSE 'Codec/Decoder/Audio' END AS klass, CASE p_size % 4 WHEN 0 THEN 'nvh264dec' WHEN 1 THEN 'avdec_h264' WHEN 2 THEN 'vah265dec' ELSE 'openh264dec' END AS name FROM part)"


@query("src_hw_classify", f"SELECT p_partkey, contains(klass, 'Decoder') AND contains(klass, 'Video') AND (contains(klass, 'Hardware') OR regexp_matches(name, '^(nv|va|msdk|amf|qsv|d3d11|d3d12)')) AS hardware FROM {NAMED}")
def src_hw_classify(t):
    k, s = F.col("p_partkey") % 3, F.col("p_size") % 4
    klass = F.when(k == 0, "Codec/Decoder/Video/Hardware").when(k == 1, "Codec/Decoder/Video").otherwise("Codec/Decoder/Audio")
    name = F.when(s == 0, "nvh264dec").when(s == 1, "avdec_h264").when(s == 2, "vah265dec").otherwise("openh264dec")
    return t.part.select("p_partkey", media.is_hardware(klass, name).alias("hardware"))


@query(
    "src_hw_fallback",
    """WITH a AS (SELECT feed_id, seq, ts_ns, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY feed_id ORDER BY seq) AS runs FROM (SELECT feed_id, seq, ts_ns, k % 3 = 0 AS ok FROM reports)),
f AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY feed_id, runs ORDER BY seq) AS failures FROM a)
SELECT feed_id, seq, cast(failures AS bigint) AS failures, failures >= 3 AS fallback, CASE WHEN failures >= 3 THEN ts_ns + 60000000000 END AS until_ns FROM f""",
)
def src_hw_fallback(t):
    rows = media.failure_runs(t.reports.select("feed_id", "seq", "ts_ns", (F.col("k") % 3 == 0).alias("ok")))
    on = F.col("failures") >= media.FAILURES
    return rows.select("feed_id", "seq", "failures", on.alias("fallback"), F.when(on, F.col("ts_ns") + media.FALLBACK_NS).alias("until_ns"))


@query("src_mock", "SELECT cast(3 AS bigint) AS feed_id, range AS seq, range * 40000000 AS ts_ns, 12 AS n_bytes FROM range(100)")
def src_mock(t):
    return media.mock_frames(t.spark, 3, 100, 2, 2, 40_000_000).select("feed_id", "seq", "ts_ns", F.octet_length("data").alias("n_bytes"))


@query(
    "join_ocm",
    """WITH v AS (SELECT *, CASE WHEN track_id % 4 <> 1 THEN 0.6e0 END AS vx, 0.8e0 AS vy, (bx0 + bx1) / 2 - (ax0 + ax1) / 2 AS dx, (by0 + by1) / 2 - (ay0 + ay1) / 2 AS dy FROM frame_pairs),
n AS (SELECT *, sqrt(dx * dx + dy * dy) AS norm FROM v)
SELECT feed_id, seq, track_id, det_id, round(CASE WHEN vx IS NULL OR norm < 1e-8 THEN 0e0 ELSE (1 - greatest(-1e0, least(1e0, (vx * dx + vy * dy) / norm))) / 2 END, 6) AS penalty FROM n""",
)
def join_ocm(t):
    a, b = Box.of(*A).center, Box.of(*B).center
    vx = F.when(F.col("track_id") % 4 != 1, F.lit(0.6))
    return t.frame_pairs.select("feed_id", "seq", "track_id", "det_id", r6(direction_penalty(vx, F.lit(0.8), b[0] - a[0], b[1] - a[1]), "penalty"))


@query("trk_z", "SELECT feed_id, seq, det_id, round(x_min + (x_max - x_min) / 2, 6) AS cx, round(y_min + (y_max - y_min) / 2, 6) AS cy, round((x_max - x_min) * (y_max - y_min), 6) AS area, round(CASE WHEN abs(y_max - y_min) > 1e-8 THEN (x_max - x_min) / (y_max - y_min) ELSE 1e0 END, 6) AS ratio FROM detections")
def trk_z(t):
    return t.detections.select(*KEYS, *[r6(c, n) for c, n in zip(Box.of().measurement(), ("cx", "cy", "area", "ratio"), strict=True)])


@query(
    "trk_bbox",
    """WITH m AS (SELECT feed_id, seq, det_id, x_min AS cx, y_min AS cy, greatest(x_max - 0.5e0, 1e-8) AS area, greatest(y_max - 0.4e0, 1e-4) AS ratio FROM detections), w AS (SELECT *, sqrt(area * ratio) AS w FROM m),
h AS (SELECT *, area / greatest(w, 1e-8) AS h FROM w) SELECT feed_id, seq, det_id, round(cx - w / 2 + 1e-9, 6) + 0e0 AS x0, round(cy - h / 2 + 1e-9, 6) + 0e0 AS y0, round(cx + w / 2 + 1e-9, 6) + 0e0 AS x1, round(cy + h / 2 + 1e-9, 6) + 0e0 AS y1 FROM h""",
)
def trk_bbox(t):
    b = Box.from_measurement(F.col("x_min"), F.col("y_min"), F.col("x_max") - 0.5, F.col("y_max") - 0.4)
    return t.detections.select(*KEYS, *[(F.round(c + 1e-9, 6) + 0.0).alias(n) for n, c in vars(b).items()])


@query("src_custom", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def src_custom(t):
    rows = media.custom_frames(t.spark, "parquet", {"path": f"{t.sf_dir}/events.parquet"}, trusted=True)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"))
