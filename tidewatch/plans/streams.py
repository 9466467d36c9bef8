"""Device windows, replay rejection and verdict routing, in batch and as streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions.metadata import encode_metadata
from tidewatch.operators import routing as R
from tidewatch.operators.scaling import Scaler
from tidewatch.plans import common as C
from tidewatch.session import cut_lineage, run_folder
from tidewatch.sources.tables import events, table
from tidewatch.streaming import detector, jobs, state

WINDOW = 4
FEATURES = ["value", "k"]


def _messages(rows):
    """Events as messages; some counters are stale, as a replayed delivery would be."""
    return rows.select(
        F.col("event_id").alias("stream_index"),
        F.col("source").cast("string").alias("device"),
        F.concat(F.lit("edge"), (F.col("source") % 3).cast("string")).alias("edge"),
        F.greatest(F.lit(0), F.col("event_id") - (F.col("k") % 3) * 400).alias("counter"),
        "label", "value", "k",
    )


def _batch(spark, folder):
    return _messages(events(spark, folder))


def _stream(spark, folder):
    schema = table(spark, folder, "events").schema
    raw = jobs.table_stream(spark, f"{folder}/events.parquet", schema)
    return _messages(raw.select(
        "event_id", F.col("user_id").alias("source"), F.col("event_type").alias("label"),
        "value", F.get_json_object("props", "$.k").cast("int").alias("k"),
    ))


def device_counter(spark, folder):
    return R.device_counter(_batch(spark, folder), "device", "stream_index", "own").select(
        "stream_index", "device", F.col("own").alias("counter")
    )


def _windows(spark, folder, buffering=False):
    counted = R.device_counter(_batch(spark, folder), "device", "stream_index", "own")
    return R.device_windows(
        counted, "device", "own", FEATURES, WINDOW, ["stream_index", "edge", "counter", "label"],
        buffering,
    )


def _window_text(df):
    return df.select(
        "device", "stream_index", C.digits(F.flatten("window")).alias("window")
    )


def device_windows(spark, folder):
    return _window_text(_windows(spark, folder))


def device_windows_stream(spark, folder):
    messages = _stream(spark, folder).select(
        "device", "stream_index", F.array("value", "k").alias("features")
    )
    rows = jobs.run_to_table(
        state.stream_windows(messages, WINDOW), run_folder(spark, "windows")
    )
    return _window_text(rows)


def buffer_depth(spark, folder):
    counted = R.device_counter(_batch(spark, folder), "device", "stream_index", "own")
    return counted.select("stream_index", R.buffer_depth("own", WINDOW).alias("depth"))


def replay_accept(spark, folder):
    return R.replay_accept(
        _batch(spark, folder), ["edge", "device"], "stream_index", "counter"
    ).select("stream_index", "accepted")


def last_accepted(spark, folder):
    return R.last_accepted(_batch(spark, folder), ["edge", "device"], "counter")


def replay_accept_stream(spark, folder):
    messages = _stream(spark, folder).select(
        F.col("edge").alias("edge_id"), F.col("device").alias("device_id"), "stream_index",
        "counter",
    )
    rows = jobs.run_to_table(
        state.stream_replay_guard(messages), run_folder(spark, "replay")
    )
    return rows.select("stream_index", "accepted")


def stream_depth(spark, folder):
    """How full each device's buffer is, from the state of a stream."""
    messages = _stream(spark, folder).select(
        "device", "stream_index", F.array("value", "k").alias("features")
    )
    base = run_folder(spark, "depth")
    jobs.run_to_table(state.stream_windows(messages, WINDOW), base)
    return state.stream_depth(spark, f"{base}/progress")


def stream_last_seen(spark, folder):
    """The last accepted counters, from the state of a stream."""
    messages = _stream(spark, folder).select(
        F.col("edge").alias("edge_id"), F.col("device").alias("device_id"), "stream_index", "counter"
    )
    base = run_folder(spark, "last-seen")
    jobs.run_to_table(state.stream_replay_guard(messages), base)
    return state.stream_last_seen(spark, f"{base}/progress").select(
        F.col("edge_id").alias("edge"), F.col("device_id").alias("device"),
        F.col("last_counter").cast("long").alias("last_counter"),
    )


def _slots(spark, folder):
    rows = cut_lineage(spark, C.split_events(spark, folder), "rows")
    scaler = Scaler.fit(rows.where("side = 'train'"), FEATURES)
    pool = R.held_out_pool(
        rows.where("side = 'test'"), "source", "pos", FEATURES, scaler, "label"
    )
    return cut_lineage(spark, R.pool_slots(pool, C.SEED), "slots")


def pair_held_out(spark, folder):
    slots = _slots(spark, folder)
    messages = _batch(spark, folder).select("stream_index")
    return R.pair_held_out(messages, slots, slots.count()).select(
        "stream_index", "ref", "true_label"
    )


def _two_classes(batch):
    """A rule in place of a fitted model: malicious when the second feature is high on average."""
    high = batch[:, :, 1].mean(axis=1) > 0.1
    return np.stack([~high, high], axis=1).astype("float64")


def detection_run(spark, folder):
    """The runtime job as a stream, from pairing to both routes, as run counters."""
    slots = _slots(spark, folder)
    messages = _stream(spark, folder).select("stream_index", "device", "edge", "counter")
    verdicts = detector.verdict_stream(
        messages, slots, slots.count(), FEATURES, WINDOW, _two_classes
    )
    run = detector.run_detection(verdicts, run_folder(spark, "detection"), "v1")
    return run.counts(table(spark, folder, "events").count())


def _verdicts(spark, folder):
    """Every message: still buffering, or judged by the mean second feature of its window."""
    level = F.aggregate("window", F.lit(0.0), lambda total, record: total + record[1]) / WINDOW
    return _windows(spark, folder, buffering=True).select(
        "stream_index", "device", "edge", "counter", "label",
        F.col("window").isNotNull().alias("classified"),
        F.coalesce(level >= 50, F.lit(False)).alias("malicious"),
    )


def verdict(spark, folder):
    return _verdicts(spark, folder).where("classified").select("stream_index", "malicious")


def route_counts(spark, folder):
    routed = R.route(_verdicts(spark, folder).where("classified"), "malicious")
    return routed.groupBy("path").agg(F.count("*").alias("n_messages"))


def route_counts_stream(spark, folder):
    """The two routes as separate jobs over single-message verdicts."""
    verdicts = _stream(spark, folder).withColumn("malicious", F.col("k") >= 50)
    base = run_folder(spark, "routes")
    started = [
        jobs.start_cloud_route(verdicts, jobs.to_parquet(f"{base}/cloud"), f"{base}/p1"),
        jobs.start_alert_route(verdicts, jobs.to_parquet(f"{base}/alert"), f"{base}/p2"),
    ]
    for query in started:
        query.awaitTermination()
    schema = "path string, malicious boolean, stream_index long"
    rows = [spark.read.schema(schema).parquet(f"{base}/{p}") for p in ("cloud", "alert")]
    return rows[0].unionByName(rows[1]).groupBy("path", "malicious").agg(
        F.count("*").alias("n_messages")
    )


def _deliveries(messages):
    """Metadata as sent, with damaged bytes and foreign edges among it."""
    sender = F.when(F.col("k") % 17 == 0, F.lit("edge9")).otherwise(F.col("edge"))
    sent = encode_metadata(sender, F.col("device"), F.col("counter"), F.lit("v1"))
    damaged = F.when(F.col("k") % 13 == 0, F.substring(sent, F.lit(1), F.lit(9))).otherwise(sent)
    return messages.select(
        "stream_index", F.col("edge").alias("edge_id"), damaged.alias("metadata")
    )


def cloud_accept(spark, folder):
    return R.cloud_accept(
        _deliveries(_batch(spark, folder)), "edge_id", "metadata", "stream_index"
    ).select("stream_index", "reject_reason")


def cloud_accept_stream(spark, folder):
    rejected, guarded = state.stream_cloud_accept(_deliveries(_stream(spark, folder)))
    rows = [
        jobs.run_to_table(part, run_folder(spark, "cloud")) for part in (rejected, guarded)
    ]
    return rows[0].unionByName(rows[1]).select("stream_index", "reject_reason")


def alert_log(spark, folder):
    alerts = R.alert_messages(R.route(_verdicts(spark, folder).where("classified"), "malicious"))
    return R.alert_log(alerts, "edge", "device", "counter", "stream_index")


def _cloud(spark, folder):
    """Benign messages with the cloud's answer."""
    benign = R.cloud_messages(
        R.route(_verdicts(spark, folder).where("classified"), "malicious")
    ).select("stream_index", "edge", "device", "counter")
    sent = benign.withColumn(
        "metadata",
        encode_metadata(F.col("edge"), F.col("device"), F.col("counter"), F.lit("v1")),
    )
    return R.cloud_accept(sent, "edge", "metadata", "stream_index").select(
        "stream_index", "reject_reason"
    )


def e2e_counts(spark, folder):
    joined = _verdicts(spark, folder).join(_cloud(spark, folder), "stream_index", "left")
    return R.run_counts(joined, alert_log(spark, folder))


def disjointness(spark, folder):
    return R.leaked_to_cloud(_cloud(spark, folder), _verdicts(spark, folder), "stream_index")


def label_agreement(spark, folder):
    judged = _verdicts(spark, folder).where("classified")
    return R.label_agreement(judged, "malicious", F.col("label") == "view").withColumn(
        "agreement", F.round("agreement", 9)
    )


QUERIES = {
    "device_counter": device_counter,
    "device_windows": device_windows,
    "device_windows_stream": device_windows_stream,
    "buffer_depth": buffer_depth,
    "replay_accept": replay_accept,
    "last_accepted": last_accepted,
    "stream_depth": stream_depth,
    "stream_last_seen": stream_last_seen,
    "replay_accept_stream": replay_accept_stream,
    "pair_held_out": pair_held_out,
    "verdict": verdict,
    "route_counts": route_counts,
    "route_counts_stream": route_counts_stream,
    "cloud_accept": cloud_accept,
    "cloud_accept_stream": cloud_accept_stream,
    "alert_log": alert_log,
    "e2e_counts": e2e_counts,
    "disjointness": disjointness,
    "label_agreement": label_agreement,
    "detection_run": detection_run,
}

_MSG = """msg AS (
  SELECT event_id AS stream_index, source::VARCHAR AS device, 'edge' || (source % 3) AS edge,
         greatest(0, event_id - (k % 3) * 400) AS counter, label, value, k,
         row_number() OVER (PARTITION BY source ORDER BY event_id) - 1 AS own FROM ev)"""
_D = "OVER (PARTITION BY device ORDER BY stream_index)"
_PAIR = """CAST(round(value * 100) AS BIGINT) || ',' || CAST(k * 100 AS BIGINT)"""
_WIN = f"""recs AS (SELECT *, {_PAIR} AS rec FROM msg),
wins AS (
  SELECT *, lag(rec, 3) {_D} || ',' || lag(rec, 2) {_D} || ',' || lag(rec, 1) {_D} || ',' || rec
            AS win,
         (lag(k, 3) {_D} + lag(k, 2) {_D} + lag(k, 1) {_D} + k) / 4.0 >= 50 AS malicious
  FROM recs)"""
_JUDGED = """judged AS (
  SELECT stream_index, device, edge, counter, label, own >= 3 AS classified,
         coalesce(malicious, false) AS malicious FROM wins)"""
_GUARD = """OVER (PARTITION BY edge, device ORDER BY stream_index
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_CLOUD = f"""cloud AS (
  SELECT *, CASE WHEN counter <= max(counter) {_GUARD} THEN 'replay' END AS reject_reason
  FROM judged WHERE classified AND NOT malicious)"""
_WINDOWS_SQL = C.sql(C.EV, _MSG, _WIN, query="""
SELECT device, stream_index, win AS "window" FROM wins WHERE own >= 3""")
_REPLAY_SQL = C.sql(C.EV, _MSG, query=f"""
SELECT stream_index, coalesce(counter > max(counter) {_GUARD}, true) AS accepted FROM msg""")
_LAST_SQL = C.sql(C.EV, _MSG, query="""
SELECT edge, device, max(counter) AS last_counter FROM msg GROUP BY ALL""")
_ACCEPT_SQL = C.sql(C.EV, _MSG, query=f"""
SELECT stream_index, CASE WHEN k % 13 = 0 THEN 'malformed' ELSE 'edge_mismatch' END
       AS reject_reason FROM msg WHERE k % 13 = 0 OR k % 17 = 0
UNION ALL
SELECT stream_index, CASE WHEN counter <= max(counter) {_GUARD} THEN 'replay' END
FROM msg WHERE k % 13 <> 0 AND k % 17 <> 0""")

_DETECTED = """fitted AS (
  SELECT avg(k) AS mk, stddev_pop(k) AS sk
  FROM pool JOIN split USING (block_id, label) WHERE side = 'train'),
slots AS (
  SELECT CAST((k - mk) / sk AS FLOAT)::DOUBLE AS level, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5('0:' || source || ':' || pos)) - 1 AS slot
  FROM pool JOIN split USING (block_id, label), fitted WHERE side = 'test'),
paired AS (SELECT msg.*, level FROM msg JOIN slots ON stream_index % n = slot),
judged AS (
  SELECT stream_index, device, edge, counter, own >= 3 AS classified,
         coalesce(avg(level) OVER (PARTITION BY device ORDER BY stream_index
                                   ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) > 0.1, false)
         AND own >= 3 AS malicious FROM paired)"""
_COUNTS = """
SELECT count(*) AS n_messages, count(*) FILTER (NOT classified) AS n_buffering,
       count(*) FILTER (classified) AS n_classified,
       count(*) FILTER (classified AND NOT malicious) AS n_benign,
       count(*) FILTER (classified AND malicious) AS n_malicious,
       (SELECT count(*) FROM cloud WHERE reject_reason IS NULL) AS cloud_received,
       (SELECT count(*) FROM cloud WHERE reject_reason IS NOT NULL) AS cloud_rejected,
       count(*) FILTER (classified AND malicious) AS alerts FROM judged"""

ORACLES = {
    "detection_run": C.sql(C.EV, C.POOL, C.SPLIT, _MSG, _DETECTED, _CLOUD, query=_COUNTS),
    "device_counter": C.sql(C.EV, _MSG, query="""
SELECT stream_index, device, own AS counter FROM msg"""),
    "device_windows": _WINDOWS_SQL,
    "device_windows_stream": _WINDOWS_SQL,
    "buffer_depth": C.sql(C.EV, _MSG, query=f"""
SELECT stream_index, least(own + 1, {WINDOW}) AS depth FROM msg"""),
    "replay_accept": _REPLAY_SQL,
    "replay_accept_stream": _REPLAY_SQL,
    "last_accepted": _LAST_SQL,
    "stream_last_seen": _LAST_SQL,
    "stream_depth": C.sql(C.EV, _MSG, query=f"""
SELECT device, least(count(*), {WINDOW}) AS depth FROM msg GROUP BY device"""),
    "pair_held_out": C.sql(C.EV, C.POOL, C.SPLIT, f"""slots AS (
  SELECT source || ':' || pos AS ref, label AS true_label, count(*) OVER () AS n,
         row_number() OVER (ORDER BY md5('{C.SEED}:' || source || ':' || pos)) - 1 AS slot
  FROM pool JOIN split USING (block_id, label) WHERE side = 'test')""", query="""
SELECT event_id AS stream_index, ref, true_label FROM ev JOIN slots ON event_id % n = slot"""),
    "verdict": C.sql(C.EV, _MSG, _WIN, _JUDGED, query="""
SELECT stream_index, malicious FROM judged WHERE classified"""),
    "route_counts": C.sql(C.EV, _MSG, _WIN, _JUDGED, query="""
SELECT CASE WHEN malicious THEN 'alert' ELSE 'cloud' END AS path, count(*) AS n_messages
FROM judged WHERE classified GROUP BY 1"""),
    "route_counts_stream": C.sql(C.EV, query="""
SELECT CASE WHEN k >= 50 THEN 'alert' ELSE 'cloud' END AS path, k >= 50 AS malicious,
       count(*) AS n_messages FROM ev GROUP BY ALL"""),
    "cloud_accept": _ACCEPT_SQL,
    "cloud_accept_stream": _ACCEPT_SQL,
    "alert_log": C.sql(C.EV, _MSG, _WIN, _JUDGED, query="""
SELECT stream_index, edge, row_number() OVER (ORDER BY stream_index) AS sequence,
       'classifier verdict: malicious (device=' || device || ', counter=' || counter || ')'
         AS reason
FROM judged WHERE classified AND malicious"""),
    "e2e_counts": C.sql(C.EV, _MSG, _WIN, _JUDGED, _CLOUD, query=_COUNTS),
    "disjointness": C.sql(C.EV, _MSG, _WIN, _JUDGED, _CLOUD, query="""
SELECT count(*) AS n_leaked FROM cloud
WHERE stream_index IN (SELECT stream_index FROM judged WHERE malicious)"""),
    "label_agreement": C.sql(C.EV, _MSG, _WIN, _JUDGED, query="""
SELECT round(avg(((NOT malicious) = (label = 'view'))::INTEGER), 9) AS agreement
FROM judged WHERE classified"""),
}
