"""Parts, dedup, caps, splits, scaling: the hand-computed cases."""

import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewatch.functions import expressions as X
from tidewatch.functions.taxonomy import CLASS_NAMES, taxonomy_rows, with_family
from tidewatch.operators import bloom, dedup, profile, sampling, scaling, split
from tidewatch.sources import csv_parts, store


def write_part(root, name, values, header="v"):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(header + "\n" + "".join(f"{v}\n" for v in values))


def column(df, name, *order):
    return [r[name] for r in df.orderBy(*(order or [name])).collect()]


# --- parts ---


def test_no_part_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        csv_parts.discover_parts(spark, str(tmp_path))


@pytest.mark.parametrize(
    ("name", "label", "number"),
    [
        ("BenignTraffic.pcap.csv", "BenignTraffic", 0),
        ("DDoS-SYN_Flood12.pcap.csv", "DDoS-SYN_Flood", 12),
        ("Y-10.pcap.csv", "Y", 10),
        ("X_-3.CSV", "X", 3),
    ],
)
def test_file_names(spark, name, label, number):
    row = spark.range(1).select(
        X.label_from_file_name(F.lit(name)), X.part_number(F.lit(name))
    ).first()
    assert tuple(row) == (label, number)


def test_positions_follow_label_part_and_line(spark, tmp_path):
    write_part(tmp_path, "b/X10.pcap.csv", [100, 101])
    write_part(tmp_path, "b/X.pcap.csv", [0, 1])
    write_part(tmp_path, "b/X2.pcap.csv", [20, 21])
    write_part(tmp_path, "a/A 1+.csv", [7])
    frame = csv_parts.with_positions(csv_parts.scan_parts(spark, str(tmp_path)))
    rows = frame.orderBy("pos").collect()
    assert [r["v"] for r in rows] == [7, 0, 1, 20, 21, 100, 101]
    assert [r["pos"] for r in rows] == list(range(7))
    assert rows[0]["source_file"] == "a/A 1+.csv"
    assert rows[1]["source_file"] == "b/X.pcap.csv"


def test_positions_across_file_splits(spark, tmp_path):
    write_part(tmp_path, "X.csv", range(20_000))
    write_part(tmp_path, "X1.csv", range(20_000, 30_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        frame = csv_parts.with_positions(csv_parts.scan_parts(spark, str(tmp_path)))
        assert frame.where(F.col("pos") == F.col("v")).count() == 30_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_other_header_fails(spark, tmp_path):
    write_part(tmp_path, "X.csv", [1], "v")
    write_part(tmp_path, "X1.csv", [2], "w")
    with pytest.raises(Exception, match="header"):
        csv_parts.scan_parts(spark, str(tmp_path)).collect()


def test_value_of_another_type_fails(spark, tmp_path):
    write_part(tmp_path, "X.csv", [1], "v")
    write_part(tmp_path, "X1.csv", ["text"], "v")
    with pytest.raises(ValueError, match="'v' is int in .*X.csv and string in .*X1.csv"):
        csv_parts.scan_parts(spark, str(tmp_path))
    integers = csv_parts.infer_layout(spark, str(tmp_path / "X.csv"))
    with pytest.raises(Exception, match="(?i)malformed"):
        csv_parts.scan_parts(spark, str(tmp_path), integers).collect()


def test_numbers_widen_over_parts(spark, tmp_path):
    parts = {"X.csv": ["1,7,a,,true", "2,,b,,false"], "X1.csv": ["3,1.5,c,,", "-4,inf,d,,true"], "X2.csv": ["3000000000,1e3,,,false"]}
    for name, lines in parts.items():
        (tmp_path / name).write_text("\n".join(["i,f,t,e,b", *lines]) + "\n")
    frame = csv_parts.scan_parts(spark, str(tmp_path))
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    assert [types[c] for c in "ifteb"] == ["bigint", "double", "string", "string", "boolean"]
    rows = csv_parts.with_positions(frame).orderBy("pos").collect()
    assert [r["i"] for r in rows] == [1, 2, 3, -4, 3000000000]
    assert [r["f"] for r in rows] == [7.0, None, 1.5, math.inf, 1000.0] and [r["b"] for r in rows][2] is None


def test_a_part_that_mixes_text_and_numbers_is_text(spark, tmp_path):
    write_part(tmp_path, "X.csv", ["a", 1], "v")
    write_part(tmp_path, "X1.csv", ["b"], "v")
    assert csv_parts.scan_parts(spark, str(tmp_path)).schema["v"].dataType.simpleString() == "string"


def test_cap_reads_whole_parts_in_number_order(spark, tmp_path):
    write_part(tmp_path, "X.pcap.csv", [0, 1])
    write_part(tmp_path, "X2.pcap.csv", [20, 21])
    write_part(tmp_path, "X10.pcap.csv", [100, 101])
    kept, counts = csv_parts.capped_subsample(spark, str(tmp_path), 4, 4, 0)
    assert column(kept, "v") == [0, 1, 20, 21]
    assert counts.first()["n_rows"] == 4


def test_cap_trims_the_part_that_crosses_it(spark, tmp_path):
    write_part(tmp_path, "Y.pcap.csv", range(5))
    write_part(tmp_path, "Y1.pcap.csv", range(10, 13))
    kept, _ = csv_parts.capped_subsample(spark, str(tmp_path), 3, 3, 0)
    values = column(kept, "v", "pos")
    assert len(values) == 3 and set(values) <= set(range(5)) and values == sorted(values)


def test_far_from_target_warns(spark, tmp_path):
    write_part(tmp_path, "Y.pcap.csv", range(5))
    with pytest.warns(UserWarning):
        csv_parts.capped_subsample(spark, str(tmp_path), 1000, 10, 0)


# --- taxonomy ---


def test_taxonomy_shape():
    rows = taxonomy_rows()
    assert len(rows) == 34 and {f for _, f, _ in rows} == set(CLASS_NAMES)
    assert [r for r in rows if r[1] == "Benign"] == [("BenignTraffic", "Benign", 0)]


def test_unknown_label_fails(spark):
    df = spark.createDataFrame([("XSS",), ("NoSuchThing",)], "label string")
    assert with_family(df.limit(1), "label").first()["class_index"] == 7
    with pytest.raises(PySparkException, match="NoSuchThing"):
        with_family(df, "label").collect()


# --- profile ---


def test_profile_counts(spark, tmp_path):
    write_part(
        tmp_path, "a.csv", ["1.5,5,x", ",5,y", "inf,5,x", "-inf,5,z", "1.5,5,x"], "a,b,label"
    )
    frame = csv_parts.scan_parts(spark, str(tmp_path), with_label=False).select("a", "b", "label")
    stats = {r["column"]: r for r in profile.profile(frame).collect()}
    assert (stats["a"]["null_count"], stats["a"]["infinite_count"]) == (1, 2)
    assert stats["label"]["infinite_count"] is None and stats["a"]["n_rows"] == 5
    assert column(profile.zero_variance(frame), "column") == ["b"]
    assert dedup.duplicate_count(frame).first()["n_duplicates"] == 1
    assert profile.imbalance_ratio(frame, "label").first()[0] == 3.0
    assert math.isnan(profile.imbalance_ratio(frame.limit(0), "label").first()[0])


def test_pearson_equals_the_built_in_aggregate(spark):
    df = spark.range(50).select(
        F.col("id").cast("double").alias("a"), F.sin("id").alias("b"), F.lit(1.0).alias("c")
    )
    pairs = {(r[0], r[1]): r[2] for r in profile.pearson_matrix(df, ["a", "b", "c"]).collect()}
    assert pairs["a", "b"] == pairs["b", "a"] == pytest.approx(df.agg(F.corr("a", "b")).first()[0])
    assert pairs["a", "c"] == pairs["c", "b"] == 0.0 and pairs["c", "c"] == 1.0


# --- dedup ---


def test_dedup_keeps_first_and_renumbers(spark):
    values = [1, 2, 99, 3, 99, 4, 99, 5, 10, 11, 88, 12, 88, 13, 88, 14]
    rows = [(i, x, "a" if i < 8 else "b") for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "pos long, x long, label string").repartition(5)
    got = dedup.deduplicate(df, "pos", bits=2).orderBy("pos").collect()
    assert [r["x"] for r in got] == [1, 2, 99, 3, 4, 5, 10, 11, 88, 12, 13, 14]
    assert [r["pos"] for r in got] == list(range(12))


def test_dedup_treats_missing_values_as_equal(spark):
    rows = [(0, float("nan")), (1, float("nan")), (2, None), (3, None), (4, 1.0)]
    df = spark.createDataFrame(rows, "pos long, x double")
    assert dedup.keep_first(df, "pos").count() == 3


@pytest.mark.parametrize("hot", [1, 5, 1 << 17])
def test_leakage_gate_with_hot_records(spark, hot):
    rows = [(i, "same" if i % 3 == 0 else f"t{i % 70}" if i % 3 == 1 else f"own{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "i long, text string").repartition(4)
    train, test = df.where("i < 500"), df.where("i >= 500")
    known = {t for i, t in rows if i < 500}
    got = sorted(r["i"] for r in dedup.leaked_rows(train, test, ["text"], hot).collect())
    assert got == [i for i, t in rows if i >= 500 and t in known]
    assert dedup.leaked_fingerprints(train, test, ["text"]).count() == len({t for i, t in rows if i >= 500} & known)


@pytest.mark.parametrize("words", [1 << 14, 64])
def test_bloom_filter_loses_no_row_and_passes_few_others(spark, words, monkeypatch):
    monkeypatch.setattr(bloom, "SHARD_WORDS", words)
    test = spark.range(4000).select(F.concat(F.lit("t"), "id").alias("x"))
    train = spark.range(40_000).select(F.concat(F.lit("t"), F.col("id") + 3000).alias("x"))
    counted = dedup._counted_prints(test, ["x"])
    # 1,000 of the train rows are in the test side.
    assert 1000 <= dedup.possible_leaks(train, ["x"], counted).count() <= 1000 + 0.01 * 40_000
    assert dedup.leaked_fingerprints(train, test, ["x"]).count() == 1000
    assert dedup.leaked_fingerprints(train, test.limit(0), ["x"]).count() == 0


def test_leakage_gate_is_not_vacuous(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "x long, label string")
    test = spark.createDataFrame([(2, "b"), (3, "c")], "x long, label string")
    assert dedup.leaked_fingerprints(train, test, ["x", "label"]).count() == 1
    assert dedup.leaked_rows(train, test, ["x", "label"]).collect()[0]["x"] == 2
    assert dedup.leaked_fingerprints(train, test.where("x > 2"), ["x", "label"]).isEmpty()


def test_fingerprint_depends_on_column_order(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    one, two = df.select(dedup.record_hash(["a", "b"]), dedup.record_hash(["b", "a"])).first()
    assert one != two and len(one) == 16


# --- samples ---


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "pos")
    one = column(sampling.sample_rows(df, "pos", 100, 1), "pos")
    assert len(one) == 100
    assert one == column(sampling.sample_rows(df.repartition(7), "pos", 100, 1), "pos")
    assert one != column(sampling.sample_rows(df, "pos", 100, 2), "pos")
    assert sampling.sample_rows(df, "pos", 5000, 1).count() == 1000
    assert sampling.sample_rows(df.limit(0), "pos", 5, 1).count() == 0


def test_trim_keeps_small_classes_whole(spark):
    df = spark.range(300).select(
        F.col("id").alias("pos"), F.when(F.col("id") < 10, "rare").otherwise("hot").alias("label")
    )
    counts = {r[0]: r[1] for r in sampling.class_counts(
        sampling.trim_to_cap(df, "label", "pos", 50, 0), "label").collect()}
    assert counts == {"rare": 10, "hot": 50}


# --- splits ---


def blocks_frame(spark, sizes):
    rows, block = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows += [(block, label), (block, label)]
            block += 1
    return spark.createDataFrame(rows, "block_id long, label string")


def test_mixed_block_fails(spark):
    df = spark.createDataFrame([(0, "a"), (0, "b")], "block_id long, label string")
    with pytest.raises(PySparkException, match="more than one label"):
        split.block_labels(df, "label").collect()


@pytest.mark.parametrize("fraction", [0.2, 0.25, 0.5])
def test_split_rounds_half_to_even_per_class(spark, fraction):
    sizes = {"a": 10, "b": 5, "c": 1, "d": 2}
    sided = split.stratified_block_split(blocks_frame(spark, sizes), "label", fraction, 0)
    got = {
        r["label"]: r["n"]
        for r in sided.where("side = 'test'").groupBy("label")
        .agg(F.count_distinct("block_id").alias("n")).collect()
    }
    assert got == {k: round(n * fraction) for k, n in sizes.items() if round(n * fraction)}
    assert sided.groupBy("block_id").agg(F.count_distinct("side").alias("n")).where(
        "n > 1").isEmpty()


def test_split_rejects_bad_fraction(spark):
    with pytest.raises(ValueError):
        split.fit_block_split(blocks_frame(spark, {"a": 2}), "label", 1.0, 0)


def test_inner_split_with_an_empty_side_fails(spark):
    with pytest.raises(ValueError, match="empty"):
        split.inner_split(blocks_frame(spark, {"a": 1, "b": 1}), "label", 0.2, 0)


@pytest.mark.parametrize("alpha", [0.1, 100.0])
@pytest.mark.parametrize("clients", [1, 3, 7])
def test_every_block_has_exactly_one_client(spark, alpha, clients):
    blocks = split.block_labels(blocks_frame(spark, {"a": 40, "b": 9, "c": 1}), "label")
    assigned = split.assign_clients(
        blocks, split.fit_clients(blocks, "label", clients, alpha, 5), "label", 5
    )
    rows = assigned.collect()
    assert sorted(r["block_id"] for r in rows) == list(range(50))
    assert all(0 <= r["client_id"] < clients for r in rows)
    histogram = split.client_histogram(assigned, "label", clients)
    assert histogram.count() == 3 * clients
    assert histogram.agg(F.sum("n_blocks")).first()[0] == 50
    # The cuts are those of the class's own Dirichlet draw.
    cuts = split.dirichlet_cuts(["a", "b", "c"], clients, alpha, 5)
    for label, n in {"a": 40, "b": 9, "c": 1}.items():
        edges = [0, *[int(c * n) for c in cuts[label]], n]
        counted = [sum(r["client_id"] == c and r["label"] == label for r in rows)
                   for c in range(clients)]
        assert counted == [b - a for a, b in zip(edges, edges[1:])]


def test_block_outside_the_corpus_fails(spark):
    blocks = blocks_frame(spark, {"a": 2})
    with pytest.raises(ValueError, match="outside"):
        split.require_known_blocks(spark.createDataFrame([(9,)], "block_id long"), blocks)


# --- scaling ---


def stats_of(df):
    return {r["feature"]: (r["count"], r["mean"], r["m2"]) for r in df.collect()}


def test_combined_mean_weighs_clients_by_rows(spark):
    rows = [("big", 0.0)] * 900 + [("small", 10.0)] * 100
    df = spark.createDataFrame(rows, "client string, x double")
    combined = scaling.combine_stats(scaling.client_stats(df, "client", ["x"]))
    assert stats_of(combined)["x"][1] == pytest.approx(1.0)


def test_combined_equals_pooled_far_from_zero(spark):
    df = spark.range(3000).select(
        (F.col("id") % 3 * F.col("id") % 7).alias("client"),
        (1e8 + F.sin("id")).alias("x"),
        F.lit(4.0).alias("flat"),
    )
    pooled = scaling.fit_scaler(df, ["x", "flat"])
    combined = scaling.combine_stats(scaling.client_stats(df, "client", ["x", "flat"]))
    assert scaling.scaler_gap(combined, pooled).first()["gap"] <= 1e-9
    scaler = scaling.Scaler.from_table(combined, ["x", "flat"])
    assert scaler.deviations[1] == 1.0
    assert scaler.transform(df).agg(F.max(F.abs("flat"))).first()[0] == 0.0


def test_scaler_refuses_bad_input(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "x double")
    with pytest.raises(PySparkException, match="non-finite"):
        scaling.fit_scaler(df, ["x"]).collect()
    with pytest.raises(PySparkException, match="zero rows"):
        scaling.fit_scaler(df.limit(0), ["x"]).collect()
    with pytest.raises(ValueError):
        scaling.fit_scaler(df, ["y"])


def test_clients_with_other_features_fail(spark):
    rows = [("a", "x", 2, 1.0, 0.0), ("b", "x", 2, 1.0, 0.0), ("a", "y", 2, 1.0, 0.0)]
    parts = spark.createDataFrame(
        rows, "client string, feature string, count long, mean double, m2 double"
    )
    with pytest.raises(PySparkException, match="disagree"):
        scaling.combine_stats(parts).collect()


def test_class_weights(spark):
    counts = spark.createDataFrame([("a", 6), ("b", 2), ("c", 0)], "label string, n long")
    got = {r["label"]: r["weight"] for r in scaling.class_weights(counts, "n").collect()}
    assert got == {"a": pytest.approx(8 / 18), "b": pytest.approx(8 / 6), "c": 0.0}
    for bad in ([("a", -1), ("b", 3)], [("a", 0)]):
        with pytest.raises(PySparkException):
            scaling.class_weights(
                spark.createDataFrame(bad, "label string, n long"), "n").collect()


# --- stores ---


def test_prepared_rows_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(0, 1.0, 2.0, "a", "train"), (1, 3.0, 4.0, "b", "test")],
        "pos long, y double, x double, label string, side string",
    )
    store.write_prepared(df, str(tmp_path / "p"), ["y", "x"])
    rows, features, scaled = store.read_prepared(spark, str(tmp_path / "p"))
    assert features == ["y", "x"] and scaled is False
    assert rows.where("side = 'test'").first()["x"] == 4.0


def test_run_tables_replace_their_own_run_only(spark, tmp_path):
    path = str(tmp_path / "metrics")
    one = spark.createDataFrame([(0.5,)], "macro_f1 double")
    for run, value in (("a", 1), ("b", 2), ("a", 3)):
        store.write_metrics(
            store.metric_rows(one.select((F.col("macro_f1") * value).alias("macro_f1")),
                              run, "c", 0, "m", ["macro_f1"]), path)
    table = store.read_table(spark, path, store.METRICS_SCHEMA)
    assert {r["run"]: r["value"] for r in table.collect()} == {"a": 1.5, "b": 1.0}
    report = str(tmp_path / "profile")
    store.write_profile(profile.profile(one), report, "a")
    stats = store.read_table(spark, report, store.PROFILE_SCHEMA)
    assert stats.where("stat = 'n_rows'").first()["value"] == "1"


def test_parameter_store(spark, tmp_path):
    path = str(tmp_path / "params")
    table = spark.createDataFrame(
        [(0, "w", 0, 1.5), (0, "w", 1, 2.5)], "client int, name string, pos int, value double"
    )
    store.save_parameters(table, path, 3, {"n_k": 12, "seed": 0})
    loaded, metadata = store.load_parameters(spark, path, 3)
    assert column(loaded, "value") == [1.5, 2.5] and store.sequence_count(metadata) == 12
    for bad in ({}, {"n_k": "twelve"}, {"n_k": "-1"}):
        with pytest.raises(ValueError):
            store.sequence_count(bad)
