"""The batch jobs end to end, from CSV parts to stored metrics.

Each step that several later steps read is written to the shared store once; everything between
two stores is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expressions import finite_rows
from tidewatch.functions.taxonomy import BENIGN_INDEX, CLASS_NAMES
from tidewatch.operators import models, split
from tidewatch.operators.dedup import deduplicate, leaked_fingerprints
from tidewatch.operators.metrics import confusion, fpr_from_confusion, macro_metrics, per_class
from tidewatch.operators.ordering import bounded_table
from tidewatch.operators.prepare import prepared_sequences
from tidewatch.operators.profile import profile
from tidewatch.operators.report import bracket
from tidewatch.operators.scaling import Scaler, client_stats, combine_stats
from tidewatch.operators.selection import select_features, selected_names
from tidewatch.session import cut_lineage
from tidewatch.sources import csv_parts, store

METRICS = [
    "macro_f1", "macro_precision", "macro_recall", "balanced_accuracy", "mcc", "accuracy",
    "false_positive_rate",
]


@dataclass(frozen=True)
class Settings:
    """Run settings; the defaults are the published configuration."""

    target: int = 1_800_000
    per_class_cap: int = 70_000
    block_size: int = 256
    test_fraction: float = 0.2
    tau: float = 0.95
    n_features: int = 16
    trees: int = 200
    forest_rows: int | None = 200_000
    sweep_sizes: tuple[int, ...] = ()
    window: int = 16
    n_clients: int = 3
    alpha: float = 0.5
    rounds: int = 20
    local_epochs: int = 3
    aggregation: str = "weighted"
    rate: float = 0.5
    seeds: tuple[int, ...] = (0, 1, 2)
    seed: int = 0


def characterise(spark: SparkSession, root: str, out: str, run: str) -> DataFrame:
    """Profile a CSV corpus into the profile table."""
    store.write_profile(profile(csv_parts.scan_parts(spark, root, with_label=False)), out, run)
    return store.read_table(spark, out, store.PROFILE_SCHEMA).where(F.col("run") == run)


def prepare(spark: SparkSession, root: str, out: str, settings: Settings) -> DataFrame:
    """CSV parts to prepared rows: cap, dedup, blocks, split, selection.

    The stored rows are unscaled and keep source, position, block and side. Equal rows on both
    sides of the split fail the job. Returns the feature table, which is stored beside the rows;
    with ``sweep_sizes`` the number of features is the knee of a sweep on the train side, stored too.
    """
    frame, _ = csv_parts.capped_subsample(
        spark, root, settings.target, settings.per_class_cap, settings.seed
    )
    rows = deduplicate(cut_lineage(spark, frame, "subsample"), "pos")
    blocks = split.make_blocks(rows, "label", "pos", settings.block_size)
    sided = split.stratified_block_split(
        cut_lineage(spark, blocks, "blocks"), "label", settings.test_fraction, settings.seed
    )
    sided = cut_lineage(spark, sided, "sides")
    train = sided.where("side = 'train'").drop("side")
    content = [c for c in train.columns if c not in ("pos", "block_id")]
    if not leaked_fingerprints(
        train, sided.where("side = 'test'"), content
    ).isEmpty():
        raise ValueError("equal rows on both sides of the split")
    table, tried = select_features(
        train, "label", "pos", settings.tau, settings.n_features, sizes=settings.sweep_sizes,
        evaluator=_evaluator(spark, train, settings) if settings.sweep_sizes else None,
        trees=settings.trees, forest_rows=settings.forest_rows, seed=settings.seed,
    )
    store.write_selection(table, tried, out)
    table = store.read_selection(spark, out)
    features = selected_names(table)
    kept = ["pos", "source_file", "label", "block_id", "side", *features]
    store.write_prepared(finite_rows(sided.select(*kept), features), out, features)
    return table


def _evaluator(spark: SparkSession, train: DataFrame, settings: Settings):
    """Validation macro-F1 of a list of columns, on a split of the train blocks alone."""
    inner = split.inner_split(train, "label", settings.test_fraction, settings.seed)
    inner = cut_lineage(spark, inner, "inner-split")

    def sequences_of(frame, columns, scaler):
        usable = finite_rows(frame, columns)
        scaler = scaler or Scaler.fit(usable, columns)
        return prepared_sequences(
            usable, "source_file", "pos", "label", columns, settings.window, scaler, keep=["pos"]
        ), scaler

    return models.sweep_evaluator(
        inner.where("side = 'train'"), inner.where("side = 'test'"), sequences_of,
        "class_index", len(CLASS_NAMES), row_id="pos", seed=settings.seed,
    )


def _scored(
    scored: DataFrame, keys: Sequence[str], n_classes: int
) -> tuple[DataFrame, DataFrame]:
    """Headline and per-class metrics from one confusion matrix per key."""
    # Classes squared per model: held once, so the test set is scored once.
    matrix = bounded_table(confusion(scored, "class_index", "prediction", n_classes, keys))
    rates = fpr_from_confusion(matrix, BENIGN_INDEX, keys)
    headline = macro_metrics(matrix, keys)
    headline = headline.join(rates, list(keys)) if keys else headline.withColumn(
        "false_positive_rate", rates.scalar()
    )
    return headline, per_class(matrix, keys)


def compare_federated(
    spark: SparkSession, prepared: str, out: str, run: str, settings: Settings
) -> DataFrame:
    """Central, local-only and federated detectors per seed, stored, and the bracket of them."""
    rows, features, scaled = store.read_prepared(spark, prepared)
    if scaled:
        raise ValueError("prepared rows must be unscaled: the scaler belongs to the clients")
    train, test = rows.where("side = 'train'"), rows.where("side = 'test'")
    n_classes, inputs = len(CLASS_NAMES), settings.window * len(features)
    passes = settings.rounds * settings.local_epochs
    config = f"K={settings.n_clients} alpha={settings.alpha} W={settings.window}"
    stored = []

    def windows(frame, scaler, source="source_file"):
        return prepared_sequences(
            frame, source, "pos", "label", features, settings.window, scaler
        )

    def judged(table, key, test_windows, sizes=None):
        names = None if sizes is None else sizes.withColumnRenamed("client", key)
        return models.score_softmax(table, key, test_windows, "class_index", n_classes, names)

    def record(scored, seed, model):
        headline, classes = _scored(scored, (), n_classes)
        stored.append(store.metric_rows(headline, run, config, seed, model, METRICS))
        stored.append(
            store.metric_rows(classes, run, config, seed, model, ["f1"], "class_index")
        )

    blocks = split.block_labels(train, "label")
    for seed in settings.seeds:
        cutoffs = split.fit_clients(
            blocks, "label", settings.n_clients, settings.alpha, seed
        )
        owned = split.assign_clients(train, cutoffs, "label", seed)
        stats = combine_stats(client_stats(owned, "client_id", features))
        scaler = Scaler.from_table(stats, features)
        test_windows = cut_lineage(spark, windows(test, scaler), "test")
        pooled = cut_lineage(spark, models.federated_data(
            windows(train, scaler).withColumn("client", F.lit(0)), "client", "class_index",
            n_classes), "pooled")
        own = owned.withColumn("__own", F.concat_ws(":", "client_id", "source_file"))
        clients = windows(own, scaler, "__own").withColumn(
            "client", F.substring_index("__own", ":", 1).cast("int")
        )
        data = cut_lineage(spark, models.federated_data(
            clients, "client", "class_index", n_classes), "clients")

        central, one = models.local_only(
            pooled, "class_index", 1, n_classes, inputs, passes, settings.rate
        )
        record(judged(central, "client_id", test_windows, one), seed, "centralized")
        alone, sizes = models.local_only(
            data, "class_index", settings.n_clients, n_classes, inputs, passes, settings.rate
        )
        scored, _ = _scored(judged(alone, "client_id", test_windows, sizes), ["model"], n_classes)
        mean = scored.agg(*[F.avg(m).alias(m) for m in METRICS])
        stored.append(store.metric_rows(mean, run, config, seed, "local_only", METRICS))
        history, sizes = models.federated_rounds(
            data, "class_index", settings.n_clients, n_classes, inputs, settings.rounds,
            settings.local_epochs, settings.rate, settings.aggregation,
        )
        shared = history.where(F.col("round") == settings.rounds - 1)
        store.save_parameters(
            shared.select(F.lit(0).alias("client"), "name", "pos", "value"), f"{out}/models/{run}", seed,
            {"n_k": str(sizes.agg(F.sum("n_k")).first()[0]), "seed": str(seed), "features": ",".join(features)},
        )
        record(judged(shared, "round", test_windows), seed, "federated")

    table = stored[0]
    for part in stored[1:]:
        table = table.unionByName(part)
    store.write_metrics(table, f"{out}/metrics")
    written = store.read_table(spark, f"{out}/metrics", store.METRICS_SCHEMA).where(
        F.col("run") == run
    )
    macro = written.where("metric = 'macro_f1' AND class IS NULL")
    return bracket(macro, ["config"], "value")
