"""Detectors trained and scored on windows of the block split."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import models as M
from tidewatch.operators import split
from tidewatch.operators.prepare import prepared_sequences
from tidewatch.operators.scaling import Scaler, client_stats, combine_stats
from tidewatch.operators.selection import sweep
from tidewatch.plans import common as C
from tidewatch.session import cut_lineage

FEATURES = ["value", "k"]
WINDOW = 2
N_CLASSES = len(C.EVENT_CLASSES)
ROUNDS, LOCAL_EPOCHS = 2, 2
INPUTS = WINDOW * len(FEATURES)


def _sides(spark, folder):
    rows = C.split_events(spark, folder).withColumnRenamed("pos", "pooled_pos")
    return C.in_source_order(rows)


def _sequences(rows, features, scaler, window=WINDOW, source="source"):
    return prepared_sequences(
        rows, source, "pos", "label", features, window, scaler,
        C.event_taxonomy(rows.sparkSession), keep=["event_id"],
    )


def _train_and_test(spark, folder, window=WINDOW, rows=None):
    rows = _sides(spark, folder) if rows is None else rows
    train, test = rows.where("side = 'train'"), rows.where("side = 'test'")
    scaler = Scaler.fit(train, FEATURES)
    return [
        cut_lineage(spark, _sequences(side, FEATURES, scaler, window), "sequences")
        for side in (train, test)
    ]


def rf_baseline(spark, folder):
    train, test = _train_and_test(spark, folder)
    model = M.fit_forest(train, "class_index", N_CLASSES, "event_id", trees=10, seed=C.SEED)
    scored = M.score_windows(model, test, "class_index", single_record=True)
    return M.evaluate(scored, "class_index", N_CLASSES)


def windowed_baseline(spark, folder):
    """Does history help: the same detector on one record and on the whole window."""
    rows = cut_lineage(spark, _sides(spark, folder), "rows")
    results = []
    for window in (1, WINDOW):
        train, test = _train_and_test(spark, folder, window, rows)
        model = M.fit_windowed(train, "class_index", N_CLASSES, 10)
        scored = M.score_windows(model, test, "class_index", single_record=False)
        results.append(
            M.evaluate(scored, "class_index", N_CLASSES).withColumn("window", F.lit(window))
        )
    return results[0].unionByName(results[1])


def score_windows(spark, folder):
    train, test = _train_and_test(spark, folder)
    model = M.fit_windowed(train, "class_index", N_CLASSES, 10)
    return M.score_windows(model, test, "class_index", False, ["event_id"]).select(
        "event_id", "class_index", "prediction",
        F.round(1.0 - F.col("probabilities")[0], 6).alias("attack_score"),
    )


def _federation(spark, folder):
    """Client training data and the shared test sequences, scaled by combined statistics."""
    rows = cut_lineage(spark, _sides(spark, folder), "rows")
    train, test = rows.where("side = 'train'"), rows.where("side = 'test'")
    cutoffs = split.fit_clients(
        split.block_labels(train, "label"), "label", C.CLIENTS, C.ALPHA, C.SEED
    )
    owned = split.assign_clients(train, cutoffs, "label", C.SEED)
    stats = combine_stats(client_stats(owned, "client_id", FEATURES))
    scaler = Scaler.from_table(stats, FEATURES)
    # A client windows its own rows only, so its sources are kept apart from other clients'.
    own_source = F.concat_ws(":", "client_id", "source")
    sequences = _sequences(
        owned.withColumn("client_source", own_source), FEATURES, scaler, source="client_source"
    ).withColumn("client_id", F.split("client_source", ":")[0].cast("int"))
    data = M.federated_data(sequences, "client_id", "class_index", N_CLASSES)
    return (
        cut_lineage(spark, data, "clients"),
        cut_lineage(spark, _sequences(test, FEATURES, scaler), "test"),
    )


def federated_rounds(spark, folder):
    """Macro metrics on the shared test set after every round."""
    data, test = _federation(spark, folder)
    history, _ = M.federated_rounds(
        data, "class_index", C.CLIENTS, N_CLASSES, INPUTS, ROUNDS, LOCAL_EPOCHS
    )
    scored = M.score_softmax(history, "round", test, "class_index", N_CLASSES)
    return M.evaluate(scored, "class_index", N_CLASSES, ["model"]).withColumnRenamed(
        "model", "round"
    )


def local_only(spark, folder):
    data, test = _federation(spark, folder)
    models, sizes = M.local_only(
        data, "class_index", C.CLIENTS, N_CLASSES, INPUTS, ROUNDS * LOCAL_EPOCHS
    )
    clients = sizes.withColumnRenamed("client", "client_id")
    scored = M.score_softmax(models, "client_id", test, "class_index", N_CLASSES, clients)
    return M.evaluate(scored, "class_index", N_CLASSES, ["model"]).withColumnRenamed(
        "model", "client_id"
    )


def f_sweep(spark, folder):
    """Validation macro-F1 for each number of features, and the knee."""
    rows = _sides(spark, folder).where("side = 'train'").drop("side")
    rows = cut_lineage(
        spark, split.inner_split(rows, "label", C.TEST_FRACTION, C.SEED), "inner"
    )

    def sequences_of(frame, columns, scaler):
        scaler = scaler or Scaler.fit(frame, columns)
        return _sequences(frame, columns, scaler), scaler

    score = M.sweep_evaluator(
        rows.where("side = 'train'"), rows.where("side = 'test'"), sequences_of,
        "class_index", N_CLASSES, iterations=5,
    )
    ranking = spark.createDataFrame([("k", 1), ("value", 2)], "feature string, fused_rank int")
    return sweep(ranking, [1], score).select(
        "n_features", F.col("score").alias("macro_f1"), F.col("chosen").alias("selected")
    )


QUERIES = {
    "rf_baseline": rf_baseline,
    "windowed_baseline": windowed_baseline,
    "score_windows": score_windows,
    "federated_rounds": federated_rounds,
    "local_only": local_only,
    "f_sweep": f_sweep,
}
# Fitted models have no SQL twin; tests/test_models.py checks them against brute force.
ORACLES: dict[str, str] = {}
