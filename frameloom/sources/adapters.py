"""Perception tables derived from the driver's tables by portable SQL, one text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FRAME_NS = 33_333_333

ADAPTERS = {
    # camera-motion reports: one per frame of a feed
    "reports": f"""
SELECT feed_id, seq, seq * {FRAME_NS} AS ts_ns, k,
       CASE WHEN k % 11 <> 0 THEN 10e0 + CASE WHEN k % 13 = 0 THEN 20e0 + k % 7 WHEN k % 4 = 0 THEN 2e0 ELSE 0e0 END END AS pan,
       CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 17 = 0 THEN 18.5e0 ELSE 0.5e0 END END AS tilt,
       CASE WHEN k % 11 <> 0 THEN CASE WHEN k % 19 = 0 THEN 0.9e0 ELSE 0.4e0 END END AS zoom,
       CASE WHEN k % 5 <> 0 THEN cast(k % 17 AS double) / 17 END AS conf,
       CASE WHEN k % 3 = 0 THEN cast(k % 40 AS double) / 100 ELSE 0e0 END AS disp,
       k % 97 = 0 AS preset,
       CASE WHEN k % 23 = 0 THEN 'Stable' WHEN k % 29 = 0 THEN 'Moving' END AS hint
FROM (SELECT cast(o_custkey % 8 AS bigint) AS feed_id, o_orderkey AS k,
             cast(row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderdate, o_orderkey) AS bigint) - 1 AS seq FROM {{orders}}) AS o""",
    "detections": """
SELECT cast(l_orderkey % 4 AS bigint) AS feed_id, l_orderkey AS seq,
       cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS bigint) AS det_id,
       cast(l_partkey % 3 AS bigint) AS class_id, 1e0 - l_discount AS conf,
       cast(l_partkey * 7 % 60 AS double) / 100 AS x_min, cast(l_suppkey * 11 % 60 AS double) / 100 AS y_min,
       cast(l_partkey * 7 % 60 AS double) / 100 + 0.1e0 + l_quantity / 200 AS x_max,
       cast(l_suppkey * 11 % 60 AS double) / 100 + 0.1e0 + l_quantity / 250 AS y_max
FROM {lineitem}""",
    # detections of a frame against its tracks: uneven ids are the tracks' predictions
    "frame_pairs": """
SELECT t.feed_id, t.seq, t.det_id AS track_id, d.det_id, t.class_id AS track_class, d.class_id AS det_class, d.conf,
       t.x_min AS ax0, t.y_min AS ay0, t.x_max AS ax1, t.y_max AS ay1, d.x_min AS bx0, d.y_min AS by0, d.x_max AS bx1, d.y_max AS by1
FROM {detections} AS t JOIN {detections} AS d ON t.feed_id = d.feed_id AND t.seq = d.seq AND t.det_id % 2 = 1 AND d.det_id % 2 = 0""",
    "observations": """
SELECT feed_id, cast(row_number() OVER (PARTITION BY feed_id ORDER BY ts_ns, event_id) AS bigint) - 1 AS seq, ts_ns, track_id, event_id AS det_id,
       cast(event_id * 37 % 1000 AS double) / 1000 AS x, cast(event_id * 91 % 1000 AS double) / 1000 AS y,
       CASE event_id % 10 WHEN 0 THEN 'Tentative' WHEN 8 THEN 'Coasted' WHEN 9 THEN CASE WHEN event_id % 30 = 9 THEN 'Lost' ELSE 'Confirmed' END ELSE 'Confirmed' END AS state,
       cast(event_id * 13 % 100 AS double) / 100 AS conf, event_id
FROM (SELECT cast(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS bigint) AS feed_id,
             cast(user_id % 20 AS bigint) AS track_id, event_id, [ts_us] * 1000 AS ts_ns FROM {events}) AS e""",
    # observations with the view epoch of their frame
    "track_points": """
SELECT *, cast((seq - seq % 400) / 400 AS bigint) AS epoch FROM {observations} AS o""",
    # four boxes a frame that move steadily, and miss every ninth frame
    "moving_boxes": """
SELECT feed_id, cast((seq - seq % 4) / 4 AS bigint) AS seq, event_id AS det_id, seq % 4 AS class_id, conf, ts_ns,
       0.05e0 + 0.2e0 * (seq % 4) + cast((seq - seq % 4) / 4 % 50 AS double) / 500 AS x_min, 0.1e0 + cast((seq - seq % 4) / 4 % 80 AS double) / 400 AS y_min,
       0.15e0 + 0.2e0 * (seq % 4) + cast((seq - seq % 4) / 4 % 50 AS double) / 500 AS x_max, 0.3e0 + cast((seq - seq % 4) / 4 % 80 AS double) / 400 AS y_max
FROM {observations} AS o WHERE cast((seq - seq % 4) / 4 AS bigint) % 9 <> 8""",
    "health_events": """
SELECT [ts_us] * 1000 AS ts_ns, user_id % 8 AS feed_id,
       CASE event_id % 25 WHEN 0 THEN 'SourceConnected' WHEN 1 THEN 'SourceDisconnected' WHEN 2 THEN 'SourceReconnecting' WHEN 3 THEN 'StageError' WHEN 4 THEN 'StagePanic'
            WHEN 5 THEN 'FeedRestarting' WHEN 6 THEN 'FeedStopped' WHEN 7 THEN 'BackpressureDrop' WHEN 8 THEN 'ViewEpochChanged' WHEN 9 THEN 'ViewDegraded'
            WHEN 10 THEN 'ViewCompensationApplied' WHEN 11 THEN 'OutputLagged' WHEN 12 THEN 'SourceEos' WHEN 13 THEN 'DecodeDecision' WHEN 14 THEN 'SinkPanic'
            WHEN 15 THEN 'SinkTimeout' WHEN 16 THEN 'SinkBackpressure' WHEN 17 THEN 'TrackAdmissionRejected' WHEN 18 THEN 'BatchError' WHEN 19 THEN 'BatchSubmissionRejected'
            WHEN 20 THEN 'BatchTimeout' WHEN 21 THEN 'BatchInFlightExceeded' WHEN 22 THEN 'FrameLag' WHEN 23 THEN 'InsecureRtspSource' ELSE 'ResidencyDowngrade' END AS kind,
       cast(floor(value) AS bigint) % 50 AS delta, event_id
FROM {events}""",
    "stage_runs": """
SELECT cast(l_orderkey % 4 AS bigint) AS feed_id, l_orderkey AS seq, l_returnflag AS stage_id,
       cast(l_linenumber AS bigint) * 1000000 AS start_ns, cast(l_linenumber AS bigint) * 1000000 + cast(floor(l_extendedprice) AS bigint) AS end_ns,
       CASE WHEN l_tax >= 0.08e0 THEN CASE l_partkey % 4 WHEN 0 THEN 'ProcessingFailed' WHEN 1 THEN 'ResourceExhausted' WHEN 2 THEN 'DependencyUnavailable' ELSE 'Panic' END END AS error
FROM {lineitem}""",
    "batch_dispatches": """
SELECT o_orderpriority AS processor_id, n AS size, cast(floor(o_totalprice) AS bigint) AS processing_ns, cast(floor(o_totalprice / 3) AS bigint) AS formation_ns,
       o_orderstatus <> 'F' AS ok, o_orderkey AS dispatch_id, o_custkey % 7 AS rejected, o_custkey % 3 AS timed_out,
       n + o_custkey % 7 + cast(o_orderkey % 8 < 2 AS int) AS submitted
FROM {orders} AS o JOIN (SELECT l_orderkey, cast(count(*) AS bigint) AS n FROM {lineitem} GROUP BY l_orderkey) AS l ON o_orderkey = l_orderkey""",
    "arrivals": """
SELECT user_id % 5 AS feed_id, cast(row_number() OVER (PARTITION BY user_id % 5 ORDER BY [ts_us], event_id) AS bigint) - 1 AS seq,
       [ts_us] * 1000 AS arrival_ns, cast(floor(value * 4000000) AS bigint) * 1000 AS service_ns, event_id FROM {events}""",
    "source_urls": """
SELECT page_id, url, CASE page_id % 4 WHEN 0 THEN replace(url, '://', '://user:pw@') WHEN 1 THEN replace(replace(url, 'https://', 'rtsp://cam:s3@'), 'http://', 'rtsp://')
       WHEN 2 THEN replace(replace(url, 'https://', 'rtsps://'), 'http://', '') ELSE url END AS source_url FROM {pages}""",
    "log_lines": """
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat(text, ' token=abc&x=1 Password=p;q') WHEN 1 THEN concat('open rtsp://u:p@h/x failed: ', text) ELSE text END AS line
FROM {conversations}""",
}
_TS = {"spark": "unix_micros(cast(ts AS timestamp))", "duckdb": "epoch_us(ts)"}


def _names(text: str) -> list[str]:
    return [n for n in (*DRIVER, *ADAPTERS) if f"{{{n}}}" in text]


def spark_frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ADAPTERS:
        text = ADAPTERS[name].replace("[ts_us]", _TS["spark"])
        return spark.sql(text, **{n: spark_frame(spark, sf_dir, n) for n in _names(text)})
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duckdb_text(name: str) -> str:
    text = ADAPTERS[name].replace("[ts_us]", _TS["duckdb"])
    return text.format(**{n: n for n in _names(text)})
