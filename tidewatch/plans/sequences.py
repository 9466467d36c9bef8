"""Runs, segments and windows over events in source order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import sequences as S
from tidewatch.operators.prepare import prepared_sequences
from tidewatch.operators.scaling import Scaler
from tidewatch.plans import common as C
from tidewatch.sources.tables import sourced_events

FEATURES = ["value", "k"]


def _train_rows(spark, folder):
    """Train rows of the block split, with the position they have in their source."""
    rows = C.split_events(spark, folder).withColumnRenamed("pos", "pooled_pos")
    return C.in_source_order(rows).where("side = 'train'")


def runs(spark, folder):
    return S.runs(sourced_events(spark, folder), "source", "pos", "label")


def segments(spark, folder):
    return S.contiguity_segments(_train_rows(spark, folder), "source", "pos").select(
        "event_id", "segment_start", "segment_id"
    )


def sequence_count(spark, folder):
    return S.count_sequences(runs(spark, folder), C.WINDOW)


def _windows(spark, folder, window=C.WINDOW):
    return S.train_windows(
        sourced_events(spark, folder), "source", "pos", "label", FEATURES, window, ["event_id"]
    )


def train_windows(spark, folder):
    return _windows(spark, folder).select(
        "event_id", "label", C.digits(F.flatten("window")).alias("window")
    )


def train_windows_of_two(spark, folder):
    return _windows(spark, folder, 2).select(
        "event_id", "label", C.digits(F.flatten("window")).alias("window")
    )


def split_train_windows(spark, folder):
    """Windows over train rows only: none reaches across a held-out block."""
    rows = S.train_windows(
        _train_rows(spark, folder), "source", "pos", "label", FEATURES, 2, ["event_id"]
    )
    return rows.select("event_id", "label", C.digits(F.flatten("window")).alias("window"))


def final_records(spark, folder):
    return _windows(spark, folder).select(
        "event_id", C.digits(S.final_record()).alias("record")
    )


def _latency(spark, folder):
    return S.latency_windows(
        sourced_events(spark, folder), "source", "pos", "label", FEATURES, C.WINDOW, "view",
        ["event_id", "k"],
    )


def latency_windows(spark, folder):
    return _latency(spark, folder).select(
        "source", "pos", "label", "boundary", "past",
        C.digits(F.flatten("window")).alias("window"),
    )


def detection_latency(spark, folder):
    judged = _latency(spark, folder).withColumn("malicious", F.col("k") >= 50)
    return S.detection_latency(judged, "source", "malicious")


def prepared(spark, folder):
    rows = sourced_events(spark, folder).withColumn(
        "value", F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    )
    finite = rows.where(F.col("value") < float("inf"))
    windows = prepared_sequences(
        rows, "source", "pos", "label", FEATURES, 2, Scaler.fit(finite, FEATURES),
        C.event_taxonomy(spark), keep=["event_id"],
    )
    return windows.select(
        "event_id", "class_index", C.digits(F.flatten("window"), 1000).alias("window")
    )


QUERIES = {
    "runs": runs,
    "segments": segments,
    "sequence_count": sequence_count,
    "train_windows": train_windows,
    "train_windows_of_two": train_windows_of_two,
    "split_train_windows": split_train_windows,
    "final_records": final_records,
    "latency_windows": latency_windows,
    "detection_latency": detection_latency,
    "prepared_sequences": prepared,
}


def print_pair(value: str = "value", k: str = "k", scale: int = 100) -> str:
    one = "CAST(round(CAST({} AS FLOAT)::DOUBLE * {}) AS BIGINT)"
    return f"{one.format(value, scale)} || ',' || {one.format(k, scale)}"


def windows_sql(table: str, window: int, label: str = "label", scale: int = 100) -> str:
    """Windows of neighbours with one label over ``table``, as text."""
    w = "OVER (PARTITION BY source ORDER BY pos)"
    same = " AND ".join(
        f"lag({label}, {i}) {w} = {label} AND lag(pos, {i}) {w} = pos - {i}"
        for i in range(1, window)
    )
    text = " || ',' || ".join(
        [f"lag(rec, {i}) {w}" for i in range(window - 1, 0, -1)] + ["rec"]
    )
    return f"""recs AS (SELECT *, {print_pair(scale=scale)} AS rec FROM {table}),
wins AS (SELECT * FROM (SELECT *, {same} AS whole, {text} AS win FROM recs) WHERE whole)"""


_RUNS = """flagged AS (
  SELECT *, coalesce(lag(label) OVER (PARTITION BY source ORDER BY pos) <> label, true)::INTEGER
            AS fresh FROM src),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY source ORDER BY pos) AS run FROM flagged),
runs AS (
  SELECT source, run, min(pos) AS run_start, max(pos) AS run_end, any_value(label) AS label,
         count(*) AS run_length FROM numbered GROUP BY source, run)"""
_TRAIN = """train AS (
  SELECT s.* FROM src s JOIN pool p USING (event_id)
  JOIN split t ON p.block_id = t.block_id AND t.side = 'train')"""
_BOUNDARIES = f"""bounds AS (
  SELECT a.source, a.run_start AS boundary, a.run_end, a.label, b.run_start AS prev_start
  FROM runs a JOIN runs b ON a.source = b.source AND a.run = b.run + 1
  WHERE b.label = 'view' AND a.label <> 'view'),
ends AS (
  SELECT *, unnest(range(1, {C.WINDOW}))::BIGINT AS past FROM bounds),
fits AS (
  SELECT *, boundary + past - 1 AS pos FROM ends
  WHERE boundary + past - 1 <= run_end AND boundary + past - {C.WINDOW} >= prev_start)"""

ORACLES = {
    "runs": C.sql(C.EV, C.SRC, _RUNS, query="""
SELECT source, run_start, run_end, label, run_length FROM runs"""),
    "segments": C.sql(C.EV, C.SRC, C.POOL, C.SPLIT, _TRAIN, query="""
SELECT event_id, min(pos) OVER (PARTITION BY source, seg) AS segment_start, seg - 1 AS segment_id
FROM (SELECT *, CAST(sum(fresh) OVER (PARTITION BY source ORDER BY pos) AS BIGINT) AS seg
      FROM (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY source ORDER BY pos) <> 1, true)
                      ::INTEGER AS fresh FROM train))"""),
    "sequence_count": C.sql(C.EV, C.SRC, _RUNS, query=f"""
SELECT CAST(sum(greatest(0, run_length - {C.WINDOW} + 1)) AS BIGINT) AS n_sequences FROM runs"""),
    "train_windows": C.sql(C.EV, C.SRC, windows_sql("src", C.WINDOW),
                           query="SELECT event_id, label, win AS \"window\" FROM wins"),
    "train_windows_of_two": C.sql(C.EV, C.SRC, windows_sql("src", 2),
                                  query="SELECT event_id, label, win AS \"window\" FROM wins"),
    "split_train_windows": C.sql(
        C.EV, C.SRC, C.POOL, C.SPLIT, _TRAIN, windows_sql("train", 2),
        query="SELECT event_id, label, win AS \"window\" FROM wins"),
    "final_records": C.sql(C.EV, C.SRC, windows_sql("src", C.WINDOW),
                           query="SELECT event_id, rec AS record FROM wins"),
    "latency_windows": C.sql(C.EV, C.SRC, _RUNS, _BOUNDARIES, query=f"""
SELECT f.source, f.pos, f.label, f.boundary, f.past,
       string_agg({print_pair('s.value', 's.k')}, ',' ORDER BY s.pos) AS "window"
FROM fits f JOIN src s ON s.source = f.source AND s.pos BETWEEN f.pos - {C.WINDOW - 1} AND f.pos
GROUP BY ALL"""),
    "detection_latency": C.sql(C.EV, C.SRC, _RUNS, _BOUNDARIES, query="""
SELECT f.source, f.boundary, min(f.past) FILTER (s.k >= 50) AS latency
FROM fits f JOIN src s USING (source, pos) GROUP BY ALL"""),
    "prepared_sequences": C.sql(
        C.EV, C.SRC, "finite AS (SELECT * FROM src WHERE event_id % 97 <> 0)",
        f"""scaled AS (
  SELECT event_id, source, pos, {C.CLASSED} AS class_index,
         (value - (SELECT avg(value) FROM finite)) / (SELECT stddev_pop(value) FROM finite)
           AS value,
         (k - (SELECT avg(k) FROM finite)) / (SELECT stddev_pop(k) FROM finite) AS k
  FROM finite)""",
        windows_sql("scaled", 2, "class_index", 1000),
        query="SELECT event_id, class_index, win AS \"window\" FROM wins"),
}
