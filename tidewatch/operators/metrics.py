"""Evaluation of verdicts, from confusion counts up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import CHUNK_BITS, by_position, in_order, running_sum

NAN = float("nan")


def _ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(otherwise))


def confusion(
    df: DataFrame, truth: str, prediction: str, n_classes: int, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, truth, prediction, n) over all declared classes, zeros kept.

    A class index outside the declared range fails the job.
    """
    keys = list(keys)
    outside = F.raise_error(F.lit("class index outside the declared classes"))
    counted = df.groupBy(
        *keys, F.col(truth).alias("truth"), F.col(prediction).alias("prediction")
    ).agg(F.count(F.lit(1)).alias("__n"))
    valid = F.col("truth").between(0, n_classes - 1) & F.col("prediction").between(
        0, n_classes - 1
    )
    cells = counted.select(
        *keys,
        F.when(valid, F.struct("truth", "prediction")).otherwise(
            F.struct(outside.cast("int").alias("truth"), outside.cast("int").alias("prediction"))
        ).alias("cell"),
        "__n",
    )
    # Every (truth, prediction) cell of the declared square, as zero rows beside the counts.
    last = F.lit(n_classes - 1)
    owners = counted.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    zeros = (
        owners.select(*keys, F.explode(F.sequence(F.lit(0), last)).alias("t"))
        .select(*keys, "t", F.explode(F.sequence(F.lit(0), last)).alias("p"))
        .select(*keys, F.struct(F.col("t").alias("truth"), F.col("p").alias("prediction"))
                .alias("cell"), F.lit(0).cast("long").alias("__n"))
    )
    return (
        cells.unionByName(zeros)
        .groupBy(*keys, "cell")
        .agg(F.sum("__n").alias("n"))
        .select(*keys, "cell.truth", "cell.prediction", "n")
    )


def per_class(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, class_index, support, predicted, precision, recall, f1); zero division gives 0."""
    keys = list(keys)
    side = F.explode(
        F.array(
            F.struct(F.col("truth").alias("class_index"), F.col("n").alias("s"),
                     F.lit(0).cast("long").alias("p"),
                     F.when(F.col("truth") == F.col("prediction"), F.col("n"))
                     .otherwise(F.lit(0).cast("long")).alias("hit")),
            F.struct(F.col("prediction").alias("class_index"),
                     F.lit(0).cast("long").alias("s"), F.col("n").alias("p"),
                     F.lit(0).cast("long").alias("hit")),
        )
    )
    sums = (
        matrix.select(*keys, side.alias("e"))
        .groupBy(*keys, "e.class_index")
        .agg(F.sum("e.s").alias("support"), F.sum("e.p").alias("predicted"),
             F.sum("e.hit").alias("hit"))
    )
    f1 = _ratio(2 * F.col("hit"), F.col("support") + F.col("predicted"))
    return sums.select(
        *keys,
        "class_index",
        "support",
        "predicted",
        "hit",
        _ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        _ratio(F.col("hit"), F.col("support")).alias("recall"),
        f1.alias("f1"),
    )


def macro_metrics(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Macro precision/recall/F1 over all declared classes, balanced accuracy over the classes
    present in truth, Matthews correlation (0 when undefined) and accuracy."""
    support, predicted = F.col("support").cast("double"), F.col("predicted").cast("double")
    total, correct = F.sum(support), F.sum("hit")
    covariance = correct * total - F.sum(support * predicted)
    spread = (total * total - F.sum(predicted * predicted)) * (
        total * total - F.sum(support * support)
    )
    return per_class(matrix, keys).groupBy(*keys).agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        _ratio(covariance, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("mcc"),
        (correct / total).alias("accuracy"),
    )


def binary_metrics(df: DataFrame, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall and false-positive rate at ``score >= threshold``; 0 when undefined."""
    flagged = F.col(score) >= threshold
    attack = F.col(truth) == 1
    tp, fp = F.count_if(attack & flagged), F.count_if(~attack & flagged)
    fn, tn = F.count_if(attack & ~flagged), F.count_if(~attack & ~flagged)
    return df.agg(
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def average_precision(df: DataFrame, truth: str, score: str, bits: int = CHUNK_BITS) -> DataFrame:
    """Sum over distinct scores, descending, of recall gained times precision.

    Equal scores form one threshold and are merged before the shuffle. NaN when only one class
    is present. Rows without a score or a truth are not ranked and do not count.
    """
    descending = df.select(
        (-F.col(score).cast("double")).alias("__key"), F.col(truth).cast("long").alias("__t")
    ).dropna()
    thresholds = descending.groupBy("__key").agg(
        F.sum("__t").alias("__hits"), F.count(F.lit(1)).alias("__n")
    )
    cumulative = by_position(
        in_order(thresholds, F.col("__key")),
        [],
        "at",
        {"__tp": running_sum(F.col("__hits")), "__seen": running_sum(F.col("__n"))},
        bits,
    )
    gained = F.sum(F.col("__hits") * F.col("__tp") / F.col("__seen"))
    positives, rows = F.sum("__hits"), F.sum("__n")
    return cumulative.agg(
        F.when((positives > 0) & (positives < rows), gained / positives)
        .otherwise(F.lit(NAN))
        .alias("pr_auc")
    )


def fpr_from_confusion(
    matrix: DataFrame, benign_index: int = 0, keys: Sequence[str] = ()
) -> DataFrame:
    """False-positive rate of the benign row; NaN when there is no benign row to judge by."""
    benign = matrix.where(F.col("truth") == benign_index)
    alarms = F.sum(F.when(F.col("prediction") != benign_index, F.col("n")).otherwise(0))
    return benign.groupBy(*keys).agg(
        _ratio(alarms, F.sum("n"), NAN).alias("false_positive_rate")
    )
