"""Detectors a Spark job can train: forest and softmax baselines, federated softmax rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.metrics import confusion, macro_metrics
from tidewatch.operators.ordering import bounded_table
from tidewatch.operators.parameters import unweighted_average, weighted_fedavg
from tidewatch.operators.sampling import sample_rows
from tidewatch.operators.scaling import class_weights
from tidewatch.operators.sequences import final_record
from tidewatch.session import cut_lineage


def _weighted(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Add the balanced class weight over the declared classes."""
    zeros = df.sparkSession.range(n_classes).select(
        F.col("id").cast(df.schema[label].dataType).alias(label), F.lit(0).alias("n")
    )
    present = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    counts = present.unionByName(zeros).groupBy(label).agg(F.sum("n").alias("n"))
    weights = class_weights(counts, "n").select(label, "weight")
    return df.join(bounded_table(weights), label)


def _vector(column):
    return array_to_vector(column.cast("array<double>"))


def fit_forest(
    sequences: DataFrame,
    label: str,
    n_classes: int,
    row_id: str,
    max_rows: int | None = 300_000,
    trees: int = 200,
    depth: int = 5,
    seed: int = 0,
):
    """Class-balanced random forest on the last record of each window."""
    if max_rows is not None:
        sequences = sample_rows(sequences, row_id, max_rows, seed)
    rows = sequences.select(label, _vector(final_record()).alias("features"))
    return RandomForestClassifier(
        labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed
    ).fit(_weighted(rows, label, n_classes))


def fit_windowed(
    sequences: DataFrame, label: str, n_classes: int, iterations: int = 30, regularise: float = 0.0
):
    """Class-weighted multinomial softmax over the whole flattened window."""
    rows = sequences.select(label, _vector(F.flatten("window")).alias("features"))
    return LogisticRegression(
        labelCol=label,
        weightCol="weight",
        family="multinomial",
        maxIter=iterations,
        regParam=regularise,
    ).fit(_weighted(rows, label, n_classes))


def score_windows(
    model, sequences: DataFrame, label: str, single_record: bool, keep: Sequence[str] = ()
) -> DataFrame:
    """(keep, label, prediction, probabilities) of a fitted ``pyspark.ml`` model."""
    record = final_record() if single_record else F.flatten("window")
    scored = model.transform(
        sequences.select(label, *keep, _vector(record).alias("features"))
    )
    return scored.select(
        *keep,
        label,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probabilities"),
    )


def score_with(
    scorer: Callable[[np.ndarray], np.ndarray],
    sequences: DataFrame,
    keep: Sequence[str],
    features: int,
) -> DataFrame:
    """Score with any function from a (batch, window, feature) array to class probabilities."""
    schema = sequences.select(*keep).schema.add("prediction", T.IntegerType()).add(
        "probabilities", T.ArrayType(T.DoubleType())
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            stacked = np.stack([np.stack(list(w)) for w in batch["window"]])
            if stacked.shape[2] != features:
                raise ValueError(f"expected {features} features, got {stacked.shape[2]}")
            probabilities = np.asarray(scorer(stacked), dtype="float64")
            yield batch[list(keep)].assign(
                prediction=probabilities.argmax(axis=1).astype("int32"),
                probabilities=list(probabilities),
            )

    return sequences.select(*keep, "window").mapInPandas(run, schema)


def evaluate(
    scored: DataFrame, label: str, n_classes: int, keys: Sequence[str] = ()
) -> DataFrame:
    return macro_metrics(confusion(scored, label, "prediction", n_classes, keys), keys)


# --- federated softmax ------------------------------------------------------------------------
#
# Models live in tables (client_id, name, pos, value), keyed like any parameters; the driver only
# counts rounds. Training rows are packed into matrices once. A step is one job: the models meet the
# blocks of their client, tasks add up gradients, and their sums meet the models again.

#: Rows in a block of training data.
BLOCK_ROWS = 4096
NAME = "softmax"
BLOCKS = "client_id int, n long, x binary, y binary, w binary"


def _softmax(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    logits = x @ weights[:-1] + weights[-1]
    logits -= logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    return e / e.sum(axis=1, keepdims=True)


def federated_data(sequences: DataFrame, client: str, label: str, n_classes: int) -> DataFrame:
    """Flat inputs with class weights computed within each client's own rows."""
    counts = sequences.groupBy(client, label).agg(F.count(F.lit(1)).alias("__n"))
    sizes = counts.groupBy(client).agg(F.sum("__n").alias("__rows"))
    weights = counts.join(sizes, client).select(
        client, label, (F.col("__rows") / (n_classes * F.col("__n"))).alias("weight")
    )
    return sequences.select(
        F.col(client).cast("int").alias("client_id"),
        F.col(label).cast("int").alias(label),
        F.flatten("window").cast("array<double>").alias("x"),
    ).join(
        bounded_table(weights.withColumnRenamed(client, "client_id")), ["client_id", label]
    )


def packed(data: DataFrame, label: str) -> DataFrame:
    """``data`` (client_id, label, weight, x) as matrices of at most ``BLOCK_ROWS`` rows of one client.

    Rows are packed where they lie, so a client that holds a third of them is many blocks in many tasks.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clients = batch["client_id"].to_numpy()
            x = batch["x"].flatten().to_numpy().reshape(batch.num_rows, -1)
            y, w = batch[label].to_numpy().astype(np.int64), batch["weight"].to_numpy()
            for client in np.unique(clients):
                own = np.flatnonzero(clients == client)
                for at in range(0, len(own), BLOCK_ROWS):
                    rows = own[at : at + BLOCK_ROWS]
                    yield pa.RecordBatch.from_pydict({
                        "client_id": pa.array([client], pa.int32()), "n": pa.array([len(rows)], pa.int64()),
                        "x": [x[rows].tobytes()], "y": [y[rows].tobytes()], "w": [w[rows].tobytes()],
                    })

    blocks = data.select("client_id", label, F.col("weight").cast("double").alias("weight"), "x")
    return cut_lineage(data.sparkSession, blocks.mapInArrow(pack, BLOCKS), "blocks")


def client_sizes(blocks: DataFrame, n_clients: int) -> DataFrame:
    """(client, n_k): the sequence count of every client, 0 where it has none."""
    found = blocks.groupBy("client_id").agg(F.sum("n").alias("n_k"))
    everyone = blocks.sparkSession.range(n_clients).select(F.col("id").cast("int").alias("client_id"))
    sizes = everyone.join(found, "client_id", "left").select(
        F.col("client_id").alias("client"), F.coalesce("n_k", F.lit(0)).alias("n_k")
    )
    return cut_lineage(blocks.sparkSession, sizes, "client-sizes")


def _as_arrays(models: DataFrame, key: str) -> DataFrame:
    """(key, weights): each model's values in order, as one array."""
    cells = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return models.groupBy(key).agg(F.transform(cells, lambda c: c["value"]).alias("weights"))


def client_gradients(blocks: DataFrame, models: DataFrame, n_classes: int) -> DataFrame:
    """(client_id, pos, gradient): the weighted loss gradient of every client over its blocks.

    ``models`` is (client_id, name, pos, value). Spark broadcasts the models if they are small, else
    both sides are shuffled by client. What a task hands on is bounded by its batches.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[int, np.ndarray] = {}
            for row in batch.to_pylist():
                weights = np.array(row["weights"]).reshape(-1, n_classes)
                x = np.frombuffer(row["x"]).reshape(row["n"], -1)
                y = np.frombuffer(row["y"], np.int64)
                error = _softmax(x, weights)
                error[np.arange(len(y)), y] -= 1.0
                error *= np.frombuffer(row["w"])[:, None]
                gradient = np.vstack([x.T @ error, error.sum(axis=0)]).ravel()
                client = row["client_id"]
                sums[client] = sums[client] + gradient if client in sums else gradient
            if sums:
                yield pa.RecordBatch.from_pydict({
                    "client_id": pa.array(list(sums), pa.int32()),
                    "gradient": pa.array([g.tolist() for g in sums.values()], pa.list_(pa.float64())),
                })

    met = blocks.join(_as_arrays(models, "client_id"), "client_id")
    partials = met.mapInArrow(fold, "client_id int, gradient array<double>")
    return (
        partials.select("client_id", F.posexplode("gradient").alias("pos", "gradient"))
        .groupBy("client_id", "pos")
        .agg(F.sum("gradient").alias("gradient"))
    )


def train_clients(
    blocks: DataFrame,
    start: DataFrame,
    sizes: DataFrame,
    n_classes: int,
    epochs: int,
    rate: float,
    proximal: float | None = None,
) -> DataFrame:
    """``epochs`` full-batch steps of every client from ``start``, all clients in each job.

    Models are (client_id, name, pos, value). A client without rows keeps its start.
    """
    spark = blocks.sparkSession
    models = start.withColumn("start", F.col("value"))
    counts = sizes.withColumnRenamed("client", "client_id")
    for _ in range(epochs):
        gradients = client_gradients(blocks, models, n_classes)
        step = F.col("gradient") / F.col("n_k")
        if proximal is not None:
            step = step + proximal * (F.col("value") - F.col("start"))
        moved = F.when(F.col("n_k") > 0, F.col("value") - rate * step).otherwise(F.col("value"))
        stepped = models.join(counts, "client_id").join(gradients, ["client_id", "pos"], "left").select(
            "client_id", "name", "pos", moved.alias("value"), "start"
        )
        models = cut_lineage(spark, stepped, "models")
    return models.drop("start")


def zero_models(spark: SparkSession, n_clients: int, inputs: int, n_classes: int) -> DataFrame:
    """A softmax detector of zeros for each client: (inputs + 1) x classes, the last row the bias."""
    last = F.lit((inputs + 1) * n_classes - 1)
    return spark.range(n_clients).select(
        F.col("id").cast("int").alias("client_id"), F.lit(NAME).alias("name"),
        F.explode(F.sequence(F.lit(0), last)).alias("pos"), F.lit(0.0).alias("value"),
    )


def federated_rounds(
    data: DataFrame,
    label: str,
    n_clients: int,
    n_classes: int,
    inputs: int,
    rounds: int,
    local_epochs: int,
    rate: float = 0.5,
    aggregation: str = "weighted",
    proximal: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rounds of: send the model out, train locally, average by sequence count.

    Returns the shared model after every round, (round, name, pos, value), and (client, n_k).
    """
    if aggregation not in ("weighted", "unweighted"):
        raise ValueError(f"unknown aggregation {aggregation!r}")
    spark = data.sparkSession
    blocks = packed(data, label)
    sizes = client_sizes(blocks, n_clients)
    start = zero_models(spark, n_clients, inputs, n_classes)
    clients = sizes.select(F.col("client").alias("client_id"))
    history = None
    for number in range(rounds):
        trained = train_clients(blocks, start, sizes, n_classes, local_epochs, rate, proximal)
        table = trained.withColumnRenamed("client_id", "client")
        merged = (
            weighted_fedavg(table, sizes) if aggregation == "weighted" else unweighted_average(table)
        )
        shared = cut_lineage(spark, merged.select(F.lit(number).alias("round"), "name", "pos", "value"), "shared")
        history = shared if history is None else history.unionByName(shared)
        # Every client starts the next round from the shared model.
        everyone = F.explode(F.sequence(F.lit(0), F.lit(n_clients - 1))).alias("client_id")
        start = shared.select(everyone, "name", "pos", "value").join(clients, "client_id", "left_semi")
    if history is None:
        history = start.where("client_id = 0").select(F.lit(-1).alias("round"), "name", "pos", "value")
    return history, sizes


def local_only(
    data: DataFrame,
    label: str,
    n_clients: int,
    n_classes: int,
    inputs: int,
    epochs: int,
    rate: float = 0.5,
) -> tuple[DataFrame, DataFrame]:
    """One model per client and no exchange: (client_id, name, pos, value) of those with rows, and
    (client, n_k) of all."""
    blocks = packed(data, label)
    sizes = client_sizes(blocks, n_clients)
    start = zero_models(data.sparkSession, n_clients, inputs, n_classes)
    trained = train_clients(blocks, start, sizes, n_classes, epochs, rate)
    empty = sizes.where("n_k = 0").select(F.col("client").alias("client_id"))
    return trained.join(empty, "client_id", "left_anti"), sizes


#: Models that a task holds against one batch of test rows.
MODELS_TOGETHER = 16


def score_softmax(
    models: DataFrame,
    model: str,
    sequences: DataFrame,
    label: str,
    n_classes: int,
    names: DataFrame | None = None,
    benign: int = 0,
) -> DataFrame:
    """(model, label, prediction) of every model on the shared test sequences.

    ``models`` is (model, pos, value). A model that only ``names`` knows predicts benign throughout.
    Every model judges every row, which is the result; models travel in groups of bounded size.
    """
    own = _as_arrays(models, model).withColumnRenamed(model, "model")
    if names is not None:
        own = names.select(F.col(model).alias("model")).distinct().join(own, "model", "left")
    own = cut_lineage(sequences.sparkSession, own, "scored-models")
    groups = max(1, -(-own.count() // MODELS_TOGETHER))
    together = own.groupBy(F.pmod(F.xxhash64("model"), F.lit(groups)).cast("int").alias("group")).agg(
        F.collect_list(F.struct("model", "weights")).alias("models")
    )
    flat = sequences.select(
        F.col(label).cast("int").alias("y"), F.flatten("window").cast("array<double>").alias("x")
    )
    out = pa.schema([("model", pa.int32()), (label, pa.int32()), ("prediction", pa.int32())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([part.num_rows], pa.int64()), "x": [part["x"].flatten().to_numpy().tobytes()],
                    "y": [part["y"].to_numpy().tobytes()],
                })

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                x, y = np.frombuffer(row["x"]).reshape(row["n"], -1), np.frombuffer(row["y"], np.int32)
                for one in row["models"]:
                    found = np.full(len(y), benign)
                    if one["weights"] is not None:
                        found = _softmax(x, np.array(one["weights"]).reshape(-1, n_classes)).argmax(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(y), one["model"], np.int32)), pa.array(y), pa.array(found.astype(np.int32))],
                        schema=out,
                    )

    blocks = flat.mapInArrow(pack, "n long, x binary, y binary")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    met = blocks.select("*", every).join(together, "group")
    return met.drop("group").mapInArrow(judge, f"model int, {label} int, prediction int")


def sweep_evaluator(
    train: DataFrame,
    validation: DataFrame,
    sequences_of: Callable[[DataFrame, list[str], object], tuple[DataFrame, object]],
    label: str,
    n_classes: int,
    max_train_sequences: int | None = None,
    row_id: str = "event_id",
    seed: int = 0,
    iterations: int = 20,
) -> Callable[[list[str]], float]:
    """A callback from candidate columns to validation macro-F1.

    ``sequences_of(frame, columns, scaler)`` returns (sequences, scaler); the scaler is fitted on
    the inner training rows only. A candidate without sequences on either side is an error.
    """

    def score(columns: list[str]) -> float:
        fitted, scaler = sequences_of(train, columns, None)
        held_out, _ = sequences_of(validation, columns, scaler)
        if fitted.isEmpty() or held_out.isEmpty():
            raise ValueError(f"no sequences to score {len(columns)} columns with")
        if max_train_sequences is not None:
            fitted = sample_rows(fitted, row_id, max_train_sequences, seed)
        model = fit_windowed(fitted, label, n_classes, iterations)
        scored = score_windows(model, held_out, label, single_record=False)
        return float(evaluate(scored, label, n_classes).first()["macro_f1"])

    return score
