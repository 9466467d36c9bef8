"""Summaries over stored run metrics, latencies and parameter traffic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import CHUNK_BITS, at_ranks

NAN = float("nan")
# Bytes per parameter, and envelope bytes per message (nonce and tag).
PARAMETER_BYTES = 4
ENVELOPE_BYTES = 32


def _measured(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def seed_summary(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean and population deviation over seeds, NaN skipped, with the usual text line."""
    measured = _measured(F.col(value))
    text = F.format_string(
        f"{name}: %.4f +/- %.4f (n=%d)",
        F.bround("mean", 4), F.bround("std", 4), F.col("n_values"),
    )
    return (
        df.groupBy(*keys)
        .agg(
            F.coalesce(F.avg(measured), F.lit(NAN)).alias("mean"),
            F.coalesce(F.stddev_pop(measured), F.lit(NAN)).alias("std"),
            F.count(F.lit(1)).alias("n_values"),
        )
        .withColumn("summary", text)
    )


def client_gap(local: DataFrame, federated: DataFrame, keys: Sequence[str], value: str):
    """Federated minus local-only, per client; positive means federation helps the client.

    ``federated`` has one row per ``keys`` (the configuration), ``local`` one per client in it.
    """
    keys = list(keys)
    shared = federated.select(*keys, F.col(value).alias("federated"))
    if not keys:
        return local.withColumn("gap", shared.select("federated").scalar() - F.col(value))
    return local.join(shared, keys).withColumn("gap", F.col("federated") - F.col(value)).drop(
        "federated"
    )


def local_only_summary(
    per_client: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Mean over all clients, with or without data, and how many had none.

    ``per_client`` holds one row per client of a dense client list, scored as constant-benign
    where ``had_no_data``.
    """
    return per_client.groupBy(*keys).agg(
        *[F.avg(v).alias(v) for v in values],
        F.count_if("had_no_data").alias("clients_without_data"),
    )


def bracket(metrics: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per configuration: is local <= federated <= central, and the share of the gap recovered.

    ``metrics`` has one row per (keys, model, seed); models are local_only, federated and
    centralized. The share is NaN when central is not above local.
    """
    wide = metrics.groupBy(*keys).agg(
        *[
            F.avg(F.when(F.col("model") == model, F.col(value))).alias(short)
            for model, short in (
                ("local_only", "low"), ("federated", "fed"), ("centralized", "up"),
            )
        ]
    )
    low, fed, up = F.col("low"), F.col("fed"), F.col("up")
    return wide.withColumns(
        {
            "inside": (low <= fed) & (fed <= up),
            "recovered": F.when(up > low, (fed - low) / (up - low)).otherwise(F.lit(NAN)),
        }
    )


def ablation_verdict(metrics: DataFrame, keys: Sequence[str], value: str, short: int, long: int):
    """Does the long window earn its place: gain over W=short above twice the seed deviation."""
    seeds = metrics.groupBy(*keys, "window").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    sides = []
    for width, side in ((short, "short"), (long, "long")):
        sides.append(
            seeds.where(F.col("window") == width).select(
                *keys, F.col("mean").alias(f"{side}_mean"), F.col("std").alias(f"{side}_std")
            )
        )
    gain = F.col("long_mean") - F.col("short_mean")
    spread = F.greatest("short_std", "long_std")
    return sides[0].join(sides[1], list(keys)).select(
        *keys, "short_mean", "long_mean", gain.alias("gain"), spread.alias("seed_std"),
        (gain > 2 * spread).alias("earned"),
    )


def run_comparison(metrics: DataFrame, reference_run: str, value: str) -> DataFrame:
    """Per (run, config, model, client): the mean over seeds, the least and most of these means
    over the run's clients, and whether every seed equals the reference run's."""
    by_client = metrics.groupBy("run", "config", "model", "client").agg(F.avg(value).alias("mean"))
    spread = by_client.groupBy("run", "config", "model").agg(
        F.min("mean").alias("least"), F.max("mean").alias("most")
    )
    by_client = by_client.join(spread, ["run", "config", "model"])
    reference = metrics.where(F.col("run") == reference_run).select(
        "config", "model", "client", "seed", F.col(value).alias("__reference")
    )
    same = (
        metrics.join(reference, ["config", "model", "client", "seed"], "left")
        .groupBy("run", "config", "model", "client")
        .agg(
            F.bool_and(
                F.coalesce(F.col(value) == F.col("__reference"), F.lit(False))
            ).alias("equals_reference")
        )
    )
    return by_client.join(same, ["run", "config", "model", "client"])


def nearest_rank_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: Sequence[float],
    rows_per_bucket: int = 1 << CHUNK_BITS,
) -> DataFrame:
    """Exact nearest-rank percentiles: the value at index half-even(p / 100 * (n - 1))."""

    def index(p: float):
        return lambda n: F.bround(F.lit(p / 100) * (n - 1)).cast("long")

    ranks = {f"p{p:g}".replace(".", "_"): index(p) for p in percentiles}
    return at_ranks(df, keys, value, ranks, rows_per_bucket)


def stage_latency(
    df: DataFrame, stage: str, value: str, rows_per_bucket: int = 1 << CHUNK_BITS
) -> DataFrame:
    """Per stage: the element at n // 2 in sorted order, mean and population deviation."""
    middle = at_ranks(
        df, [stage], value, {"median": lambda n: F.floor(n / 2)}, rows_per_bucket
    )
    spread = df.groupBy(stage).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return middle.join(spread, stage).select(stage, "n", "median", "mean", "std")


def round_cost(parameters: DataFrame, round_id: str, client: str) -> DataFrame:
    """Bytes per round: both directions of every client's parameters, plus their envelopes."""
    sizes = parameters.groupBy(round_id, client).agg(F.count(F.lit(1)).alias("__size"))
    return sizes.groupBy(round_id).agg(
        F.count(F.lit(1)).alias("n_clients"),
        (2 * PARAMETER_BYTES * F.sum("__size")).alias("payload_bytes"),
        (2 * ENVELOPE_BYTES * F.count(F.lit(1))).alias("envelope_bytes"),
    )


def nonce_reuse(messages: DataFrame, key_id: str, nonce: str) -> DataFrame:
    """(key, nonce) pairs issued more than once; the audit wants none."""
    return (
        messages.groupBy(key_id, nonce)
        .agg(F.count(F.lit(1)).alias("n_issued"))
        .where(F.col("n_issued") > 1)
    )
