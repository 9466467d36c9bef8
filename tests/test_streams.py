"""Routing, replay and device windows: hand cases, and streams equal to their batch twins."""

import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewatch.functions.metadata import decode_metadata, encode_metadata
from tidewatch.operators import routing as R
from tidewatch.streaming import detector, jobs, state


def feed(spark, folder, batches, schema):
    """One file per micro-batch, oldest first."""
    import os

    for i, rows in enumerate(batches):
        part = f"{folder}/in{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)
        for name in os.listdir(part):
            if name.endswith(".parquet"):
                os.utime(f"{part}/{name}", (1_000_000 + i, 1_000_000 + i))
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.parquet")
        .parquet(str(folder))
    )


PUSH = "device string, stream_index long, features array<double>, reset boolean"


def windows_of(spark, tmp_path, batches, window):
    (tmp_path / "src").mkdir()
    stream = feed(spark, tmp_path / "src", batches, PUSH)
    rows = jobs.run_to_table(state.stream_windows(stream, window), str(tmp_path / "out")).collect()
    return sorted((r["device"], r["stream_index"], [x[0] for x in r["window"]]) for r in rows)


def test_windows_slide_across_micro_batches(spark, tmp_path):
    batches = [
        [("a", 2, [3.0], False), ("a", 0, [1.0], False), ("b", 1, [2.0], False)],
        [("a", 3, [4.0], False), ("b", 4, [5.0], False)],
        [("a", 5, [6.0], False), ("b", 6, [7.0], False)],
    ]
    assert windows_of(spark, tmp_path, batches, 3) == [
        ("a", 3, [1.0, 3.0, 4.0]), ("a", 5, [3.0, 4.0, 6.0]), ("b", 6, [2.0, 5.0, 7.0]),
    ]


def test_reset_empties_one_device(spark, tmp_path):
    batches = [
        [("a", 0, [1.0], False), ("b", 1, [2.0], False)],
        [("a", 2, None, True)],
        [("a", 3, [3.0], False), ("b", 4, [4.0], False)],
        [("a", 5, [5.0], False)],
    ]
    assert windows_of(spark, tmp_path, batches, 2) == [
        ("a", 5, [3.0, 5.0]), ("b", 4, [2.0, 4.0]),
    ]


@pytest.mark.parametrize("window", [1, 2])
def test_feature_count_is_fixed_per_device(spark, tmp_path, window):
    batches = [[("a", 0, [1.0], False)], [("a", 1, [1.0, 2.0], False)]]
    with pytest.raises(Exception, match="expected 1 features"):
        windows_of(spark, tmp_path, batches, window)


COUNTERS = [("e", "d", 0, 5), ("e", "d", 1, 5), ("e", "d", 2, 4), ("e", "x", 3, 1),
            ("e", "d", 4, 6), ("f", "d", 5, 0), ("e", "d", 6, 3), ("e", "d", 7, 2**64 - 1),
            ("e", "d", 8, 2**63)]
ACCEPTED = [True, False, False, True, True, True, False, True, False]
REPLAY = "edge_id string, device_id string, stream_index long, counter decimal(20,0)"


def decimals(rows):
    from decimal import Decimal

    return [(*r[:3], Decimal(r[3])) for r in rows]


def test_replay_in_batch(spark):
    df = spark.createDataFrame(decimals(COUNTERS), REPLAY)
    for bits in (1, 18):
        got = R.replay_accept(df, ["edge_id", "device_id"], "stream_index", "counter", bits)
        assert [r["accepted"] for r in got.orderBy("stream_index").collect()] == ACCEPTED
    with pytest.raises(PySparkException, match="non-negative"):
        bad = spark.createDataFrame(decimals([("e", "d", 0, -1)]), REPLAY)
        R.replay_accept(bad, ["edge_id", "device_id"], "stream_index", "counter").collect()


@pytest.mark.parametrize("cuts", [[], [1], [2, 5], [1, 2, 3, 4, 5, 6, 7, 8]])
def test_replay_stream_equals_batch(spark, tmp_path, cuts):
    rows = decimals(COUNTERS)
    edges = [0, *cuts, len(rows)]
    (tmp_path / "src").mkdir()
    stream = feed(
        spark, tmp_path / "src", [rows[a:b] for a, b in zip(edges, edges[1:])], REPLAY
    )
    out = jobs.run_to_table(state.stream_replay_guard(stream), str(tmp_path / "out"))
    assert [r["accepted"] for r in out.orderBy("stream_index").collect()] == ACCEPTED


# --- metadata ---


def encoded(spark, edge="edge01", device="sensor1", counter="5", schema="v1"):
    return spark.range(1).select(
        encode_metadata(
            F.lit(edge), F.lit(device), F.lit(counter).cast("decimal(38,0)"), F.lit(schema)
        ).alias("m")
    )


def wire(edge, device, counter, schema):
    out = b"\x01"
    for part in (edge, device):
        out += len(part.encode()).to_bytes(2, "big") + part.encode()
    return (out + counter.to_bytes(8, "big")
            + len(schema.encode()).to_bytes(2, "big") + schema.encode())


@pytest.mark.parametrize("counter", [0, 5, 255, 2**63, 2**64 - 1])
@pytest.mark.parametrize("device", ["", "sensor1", "gerät-ß"])
def test_metadata_bytes_round_trip(spark, counter, device):
    df = encoded(spark, device=device, counter=str(counter))
    assert bytes(df.first()["m"]) == wire("edge01", device, counter, "v1")
    back = df.select(decode_metadata(F.col("m")).alias("d")).select("d.*").first()
    assert (back["edge_id"], back["device_id"], int(back["counter"]), back["schema_version"]) == (
        "edge01", device, counter, "v1")


def test_field_boundaries_are_told_apart(spark):
    assert encoded(spark, "ab", "c").first() != encoded(spark, "a", "bc").first()


def test_oversized_values_fail(spark):
    assert len(encoded(spark, device="x" * 65_535).first()["m"]) > 65_535
    with pytest.raises(PySparkException, match="exceeds"):
        encoded(spark, device="x" * 65_536).collect()
    for counter in ("-1", str(2**64)):
        with pytest.raises(PySparkException, match="counter"):
            encoded(spark, counter=counter).collect()


def test_malformed_bytes_decode_to_null(spark):
    good = wire("e", "d", 7, "v1")
    bad = [good[:i] for i in range(len(good))]
    bad += [good + b"\x00", b"\x02" + good[1:], b"", good.replace(b"d", b"\xff"), None]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None,) for b in [good, *bad]],
                               "m binary")
    decoded = [r[0] for r in df.select(decode_metadata(F.col("m"))).collect()]
    assert decoded[0]["device_id"] == "d" and decoded[1:] == [None] * len(bad)


# --- cloud and routes ---


def deliveries(spark, rows):
    data = [(i, edge, bytearray(m)) for i, (edge, m) in enumerate(rows)]
    return spark.createDataFrame(data, "stream_index long, edge_id string, metadata binary")


HAND = [
    ("edge02", wire("edge01", "d", 5, "v1")),
    ("edge01", wire("edge01", "d", 5, "v1")),
    ("edge01", wire("edge01", "d", 5, "v1")),
    ("edge01", b"junk"),
    ("edge01", wire("edge01", "d", 6, "v1")),
]
REASONS = ["edge_mismatch", None, "replay", "malformed", None]


def test_rejected_messages_leave_the_replay_state_alone(spark):
    got = R.cloud_accept(deliveries(spark, HAND), "edge_id", "metadata", "stream_index", bits=1)
    assert [r["reject_reason"] for r in got.orderBy("stream_index").collect()] == REASONS


def test_cloud_stream_equals_batch(spark, tmp_path):
    (tmp_path / "src").mkdir()
    rows = [tuple(r) for r in deliveries(spark, HAND).collect()]
    schema = "stream_index long, edge_id string, metadata binary"
    stream = feed(spark, tmp_path / "src", [rows[:2], rows[2:]], schema)
    parts = state.stream_cloud_accept(stream)
    out = [jobs.run_to_table(p, str(tmp_path / f"out{i}")) for i, p in enumerate(parts)]
    rows = out[0].unionByName(out[1]).orderBy("stream_index").collect()
    assert [r["reject_reason"] for r in rows] == REASONS


def test_cloud_stream_decodes_the_metadata_once(spark):
    def decodings(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("transform(")

    sent = deliveries(spark, HAND)
    once = decodings(sent.select(decode_metadata(F.col("metadata")).alias("meta")))
    assert once > 0
    assert [decodings(part) for part in state.stream_cloud_accept(sent)] == [once, once]


def small_files(spark, folder, n):
    spark.range(n).select("id", (F.col("id") % 2 == 0).alias("malicious")).repartition(n).write.parquet(folder)
    return "id long, malicious boolean"


def batches_of(progress):
    return sum(not name.startswith(".") for name in os.listdir(f"{progress}/commits"))


def test_small_files_of_a_table_share_a_micro_batch(spark, tmp_path):
    schema = small_files(spark, f"{tmp_path}/table", 6)
    stream = jobs.table_stream(spark, f"{tmp_path}/table", schema)
    assert jobs.run_to_table(stream, f"{tmp_path}/out").count() == 6
    assert batches_of(f"{tmp_path}/out/progress") == 1
    # A bound below a file's size still takes a file at a time, and all of them.
    stream = jobs.file_stream(spark, f"{tmp_path}/table", schema, files_per_batch=None, bytes_per_batch=1)
    assert jobs.run_to_table(stream, f"{tmp_path}/single").count() == 6
    assert batches_of(f"{tmp_path}/single/progress") == len(
        [name for name in os.listdir(f"{tmp_path}/table") if name.endswith(".parquet")]
    )


def test_routes_read_the_verdict_files_of_many_partitions_together(spark, tmp_path):
    schema = small_files(spark, f"{tmp_path}/table", 6)
    verdicts = jobs.table_stream(spark, f"{tmp_path}/table", schema).select(
        F.col("id").alias("stream_index"), F.lit("e").alias("edge"), F.lit("d").alias("device"),
        F.col("id").alias("counter"), "malicious",
    )
    got = detector.run_detection(verdicts, f"{tmp_path}/run", "v1").counts(6).first()
    assert (got["n_classified"], got["cloud_received"], got["alerts"]) == (6, 3, 3)
    files = [n for n in os.listdir(f"{tmp_path}/run/verdicts/rows") if n.endswith(".parquet")]
    assert len(files) > 1
    assert batches_of(f"{tmp_path}/run/cloud-progress") == batches_of(f"{tmp_path}/run/alert-progress") == 1


def test_malicious_only_run_never_touches_the_cloud(spark, tmp_path):
    (tmp_path / "src").mkdir()
    rows = [(i, True) for i in range(5)]
    stream = feed(spark, tmp_path / "src", [rows], "stream_index long, malicious boolean")
    seen = {"cloud": 0, "alert": 0}

    def sink(name):
        def write(batch, batch_id):
            seen[name] += batch.count()

        return write

    jobs.start_cloud_route(stream, sink("cloud"), str(tmp_path / "p1")).awaitTermination()
    jobs.start_alert_route(stream, sink("alert"), str(tmp_path / "p2")).awaitTermination()
    assert seen == {"cloud": 0, "alert": 5}


def test_alert_route_has_no_way_to_the_cloud():
    import inspect

    assert "cloud" not in inspect.signature(jobs.start_alert_route).parameters


def test_alert_log_numbers_alerts(spark):
    df = spark.createDataFrame(
        [(3, "e", "d1", 0), (9, "f", "d2", 4)], "i long, edge string, device string, counter long"
    )
    rows = R.alert_log(df, "edge", "device", "counter", "i").orderBy("sequence").collect()
    assert [(r["sequence"], r["edge"]) for r in rows] == [(1, "e"), (2, "f")]
    assert rows[1]["reason"] == "classifier verdict: malicious (device=d2, counter=4)"
    with pytest.raises(PySparkException, match="non-empty"):
        R.alert_log(df.withColumn("edge", F.lit("")), "edge", "device", "counter", "i").collect()


# --- pairing ---


def pool(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("f:"), F.col("id").cast("string")).alias("ref"), F.lit("x").alias("true_label")
    )


def test_pairing_goes_by_stream_index_and_wraps(spark):
    slots = R.pool_slots(pool(spark, 20), 0)
    assert sorted(r["slot"] for r in slots.collect()) == list(range(20))
    messages = spark.range(45).select(
        F.col("id").alias("stream_index"), (F.col("id") % 3).alias("device"),
        F.floor(F.col("id") / 3).alias("counter"),
    )
    by_index = {r["stream_index"]: r["ref"]
                for r in R.pair_held_out(messages, slots, 20).collect()}
    assert len({by_index[i] for i in range(3)}) == 3 and by_index[0] == by_index[20] == by_index[40]
    # Negative control: device counters restart, so the first messages would share one record.
    by_counter = R.pair_held_out(messages.where("counter = 0"), slots, 20, "counter").collect()
    assert len({r["ref"] for r in by_counter}) == 1


def test_pairing_refuses_bad_input(spark):
    slots = R.pool_slots(pool(spark, 3), 0)
    with pytest.raises(ValueError):
        R.pair_held_out(spark.range(1).withColumnRenamed("id", "stream_index"), slots, 0)
    with pytest.raises(PySparkException, match="non-negative"):
        bad = spark.range(1).select((F.col("id") - 1).alias("stream_index"))
        R.pair_held_out(bad, slots, 3).collect()


def test_device_windows_batch_hand_case(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([1, 2, 3, 4])] + [("b", 0, 9.0)]
    df = spark.createDataFrame(rows, "device string, counter long, x double")
    for bits in (2, 18):
        got = R.device_windows(df, "device", "counter", ["x"], 3, bits=bits).collect()
        assert sorted((r["counter"], [x[0] for x in r["window"]]) for r in got) == [
            (2, [1.0, 2.0, 3.0]), (3, [2.0, 3.0, 4.0])]


@pytest.mark.parametrize(("window", "classified"), [(2, 4), (9, 0)])
def test_detection_run_without_benign_verdicts(spark, tmp_path, window, classified):
    def always_malicious(batch):
        return [[0.0, 1.0]] * len(batch)

    (tmp_path / "src").mkdir()
    rows = [(i, "d", "e", i) for i in range(5)]
    stream = feed(spark, tmp_path / "src", [rows[:2], rows[2:]],
                  "stream_index long, device string, edge string, counter long")
    slots = R.pool_slots(pool(spark, 3).withColumn("x", F.lit(1.0)), 0)
    verdicts = detector.verdict_stream(stream, slots, 3, ["x"], window, always_malicious)
    run = detector.run_detection(verdicts, str(tmp_path / "run"), "v1")
    assert tuple(run.counts(5).first()) == (5, 5 - classified, classified, 0, classified, 0, 0,
                                            classified)


def test_depth_and_last_seen_follow_the_stream(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("aab"), i, [float(i)], rng.random() < 0.1) for i in range(60)]
    files = [rows[i : i + 3] for i in range(0, 60, 3)]
    (tmp_path / "src").mkdir()
    for n in (1, 3, 20):
        done = len(list((tmp_path / "src").iterdir()))
        for i in range(done, n):
            part = tmp_path / "made" / str(i)
            spark.createDataFrame(files[i], PUSH).coalesce(1).write.parquet(str(part))
            source = next(part.glob("*.parquet"))
            source.rename(tmp_path / "src" / f"{i}.parquet")
        stream = jobs.file_stream(spark, str(tmp_path / "src"), PUSH)
        jobs.run_to_table(state.stream_windows(stream, 4), str(tmp_path / "windows"))
        depth = {}
        for device, _, _, reset in rows[: 3 * n]:
            depth[device] = 0 if reset else min(4, depth.get(device, 0) + 1)
        got = {r["device"]: r["depth"] for r in state.stream_depth(spark, str(tmp_path / "windows/progress")).collect()}
        assert got == {d: n for d, n in depth.items() if n}
        counters = stream.select(
            F.lit("e").alias("edge_id"), F.col("device").alias("device_id"), "stream_index",
            ((F.col("stream_index") * 7) % 31).alias("counter"),
        )
        jobs.run_to_table(state.stream_replay_guard(counters), str(tmp_path / "guard"))
        last = {}
        for device, i, *_ in rows[: 3 * n]:
            last[device] = max(last.get(device, -1), i * 7 % 31)
        seen = state.stream_last_seen(spark, str(tmp_path / "guard/progress")).collect()
        assert {r["device_id"]: int(r["last_counter"]) for r in seen} == last


def test_counters_of_micro_batches_and_a_lost_alert(spark, tmp_path):
    import numpy as np

    def by_first(batch):
        high = batch[:, -1, 0] > 0
        return np.stack([~high, high], axis=1).astype(float)

    (tmp_path / "src").mkdir()
    rows = [(i, "de"[i % 2], "e", i) for i in range(9)]
    stream = feed(spark, tmp_path / "src", [rows[:4], rows[4:6], rows[6:]],
                  "stream_index long, device string, edge string, counter long")
    slots = R.pool_slots(pool(spark, 2).withColumn("x", F.when(F.col("ref") == "f:0", 1.0).otherwise(-1.0)), 0)
    verdicts = detector.verdict_stream(stream, slots, 2, ["x"], 2, by_first)
    run = detector.run_detection(verdicts, str(tmp_path / "run"), "v1")
    assert run.counters.count() == 3 and run.counters.agg(F.sum("n_classified")).first()[0] == 7
    counts = run.counts(9)
    assert 0 < counts.first()["n_malicious"] < 7 and R.count_errors(counts).isEmpty()
    lost = detector.DetectionRun(run.verdicts, run.cloud, run.alerts.limit(run.alerts.count() - 1), run.counters)
    assert not R.count_errors(lost.counts(9)).isEmpty()


def test_workers_need_no_import_path(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    code = tmp_path / "processor.bin"
    code.write_bytes(cloudpickle.dumps(state._Windows(3, [])))
    script = f"import pickle; print(pickle.load(open({str(code)!r}, 'rb'))._window)"
    done = subprocess.run(
        [sys.executable, "-c", script], cwd="/", capture_output=True, text=True, check=True
    )
    assert done.stdout.strip() == "3"
