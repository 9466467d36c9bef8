"""Federated softmax against plain numpy, and the fitted baselines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import models as M
from tidewatch.plans import QUERIES

CLASSES = 3


def sequences(spark, n=120):
    y = F.col("id") % CLASSES
    noise = (F.xxhash64("id") % 100) / 200.0
    record = F.array((y + noise).cast("float"), (2 - y + noise).cast("float"))
    return spark.range(n).select(
        F.col("id").alias("event_id"),
        y.cast("int").alias("y"),
        # Client 2 of 3 has nothing.
        F.when(F.col("id") < 40, 0).otherwise(1).alias("client"),
        F.array(record, record).alias("window"),
    )


def softmax(x, w):
    logits = x @ w[:-1] + w[-1]
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def numpy_client(rows, start, epochs, rate, proximal=None):
    x = np.array([r["x"] for r in rows])
    y = np.array([r["y"] for r in rows])
    counts = np.bincount(y, minlength=CLASSES)
    weight = len(y) / (CLASSES * counts[y])
    w = start.copy()
    for _ in range(epochs):
        error = (softmax(x, w) - np.eye(CLASSES)[y]) * weight[:, None]
        gradient = np.vstack([x.T @ error, error.sum(axis=0)]) / len(y)
        if proximal is not None:
            gradient = gradient + proximal * (w - start)
        w = w - rate * gradient
    return w


def weights_of(table):
    return np.array([r["value"] for r in table.orderBy("pos").collect()]).reshape(-1, CLASSES)


@pytest.mark.parametrize("aggregation", ["weighted", "unweighted"])
@pytest.mark.parametrize("proximal", [None, 0.3])
def test_rounds_equal_numpy(spark, aggregation, proximal):
    data = M.federated_data(sequences(spark).repartition(5), "client", "y", CLASSES).persist()
    history, sizes = M.federated_rounds(
        data, "y", 3, CLASSES, 4, rounds=2, local_epochs=2, rate=0.3,
        aggregation=aggregation, proximal=proximal,
    )
    assert {r["client"]: r["n_k"] for r in sizes.collect()} == {0: 40, 1: 80, 2: 0}
    model = weights_of(history.where("round = 1"))
    rows = data.collect()
    expected = np.zeros((5, CLASSES))
    for _ in range(2):
        trained = [
            numpy_client([r for r in rows if r["client_id"] == c], expected, 2, 0.3, proximal)
            for c in (0, 1)
        ] + [expected]
        shares = [40 / 120, 80 / 120, 0] if aggregation == "weighted" else [1 / 3] * 3
        expected = sum(s * t for s, t in zip(shares, trained))
    assert np.allclose(model, expected, atol=1e-10)


def test_local_only_scores_an_empty_client_as_benign(spark):
    data = M.federated_data(sequences(spark), "client", "y", CLASSES).persist()
    models, sizes = M.local_only(data, "y", 3, CLASSES, 4, epochs=3)
    assert [r["client"] for r in sizes.where("n_k = 0").collect()] == [2]
    assert models.where("client_id = 2").isEmpty()
    names = sizes.withColumnRenamed("client", "client_id")
    scored = M.score_softmax(models, "client_id", sequences(spark), "y", CLASSES, names)
    assert scored.count() == 360
    assert scored.where("model = 2 AND prediction <> 0").isEmpty()
    start = np.zeros((5, CLASSES))
    rows = [r for r in data.collect() if r["client_id"] == 0]
    assert np.allclose(weights_of(models.where("client_id = 0")), numpy_client(rows, start, 3, 0.5))


def test_blocks_and_groups_of_models_do_not_change_scores(spark, monkeypatch):
    data = M.federated_data(sequences(spark).repartition(3), "client", "y", CLASSES)
    found = []
    for rows, together in ((4096, 16), (7, 1)):
        monkeypatch.setattr(M, "BLOCK_ROWS", rows)
        monkeypatch.setattr(M, "MODELS_TOGETHER", together)
        models, _ = M.local_only(data, "y", 3, CLASSES, 4, epochs=2)
        scored = M.score_softmax(models, "client_id", sequences(spark), "y", CLASSES)
        found.append(sorted(map(tuple, scored.collect())))
    assert found[0] == found[1] and len(found[0]) == 240


def test_baselines_learn_separable_classes(spark):
    df = sequences(spark)
    forest = M.fit_forest(df, "y", CLASSES, "event_id", max_rows=100, trees=5)
    single = M.evaluate(M.score_windows(forest, df, "y", True), "y", CLASSES).first()
    flat = M.fit_windowed(df, "y", CLASSES, 20)
    whole = M.evaluate(M.score_windows(flat, df, "y", False), "y", CLASSES).first()
    assert single["macro_f1"] > 0.95 and whole["macro_f1"] > 0.95


def test_plug_in_scorer(spark):
    def scorer(batch):
        assert batch.shape[1:] == (2, 2)
        return np.eye(CLASSES)[np.clip(np.round(batch[:, -1, 0] - 0.1), 0, 2).astype(int)]

    got = M.score_with(scorer, sequences(spark), ["event_id"], 2)
    assert got.count() == 120 and set(got.columns) == {"event_id", "prediction", "probabilities"}
    with pytest.raises(Exception, match="expected 3 features"):
        M.score_with(scorer, sequences(spark), ["event_id"], 3).collect()


def test_sweep_refuses_an_unscorable_candidate(spark):
    df = sequences(spark)

    def nothing(frame, columns, scaler):
        return frame.limit(0), scaler

    with pytest.raises(ValueError, match="no sequences"):
        M.sweep_evaluator(df, df, nothing, "y", CLASSES)(["a"])


@pytest.mark.parametrize("name", ["federated_rounds", "local_only", "f_sweep", "windowed_baseline"])
def test_model_queries_give_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0
