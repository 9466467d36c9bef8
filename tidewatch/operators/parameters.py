"""Aggregation of client parameter tables.

A parameter table is long: (client, name, pos, value), with ``is_float`` where some entries are
counters rather than weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import bounded_table


def from_vectors(df: DataFrame, client: str, vector: str, name: str = "embedding") -> DataFrame:
    """Long parameters from one array per row."""
    return df.select(
        F.col(client).alias("client"),
        F.lit(name).alias("name"),
        F.posexplode(vector).alias("pos", "value"),
    )


def _checked(merged: DataFrame, n_clients: Column) -> Column:
    """Every client must report every parameter exactly once."""
    broken = F.raise_error(
        F.concat(
            F.lit("clients do not all report "), F.col("name"), F.lit("["),
            F.col("pos").cast("string"), F.lit("]"),
        )
    )
    return F.when(F.col("__clients") != n_clients, broken.cast("double")).otherwise(
        F.col("value")
    )


def weighted_fedavg(parameters: DataFrame, counts: DataFrame) -> DataFrame:
    """Sum of n_k / n times each client's value, by (name, pos), in doubles.

    ``counts`` is (client, n_k) over all clients. A client with n_k = 0 weighs nothing; negative
    or all-zero counts fail the job, and so does a parameter some client lacks. Entries that are
    not floats are copied from the first client.
    """
    summary = counts.agg(
        F.sum("n_k").alias("total"), F.min("n_k").alias("least"), F.count("*").alias("k")
    )
    total = summary.select("total").scalar()
    bad = F.raise_error(F.lit("sequence counts must be non-negative and not all zero"))
    weight = F.when(
        (summary.select("least").scalar() < 0) | (total <= 0) | F.col("n_k").isNull(),
        bad.cast("double"),
    ).otherwise(F.col("n_k").cast("double") / total)
    weighted = parameters.join(bounded_table(counts), "client", "left").withColumn(
        "__w", weight
    )
    return _combine(weighted, summary.select("k").scalar())


def unweighted_average(parameters: DataFrame) -> DataFrame:
    """Plain mean over clients."""
    k = parameters.agg(F.count_distinct("client").alias("k")).scalar()
    return _combine(parameters.withColumn("__w", 1.0 / k.cast("double")), k)


def _combine(weighted: DataFrame, n_clients: Column) -> DataFrame:
    # Averaged in doubles, then back in the type that came in.
    kind = weighted.schema["value"].dataType
    value = F.col("value").cast("double")
    total = F.sum(value * F.col("__w"))
    if "is_float" in weighted.columns:
        result = F.when(F.bool_and("is_float"), total).otherwise(F.min_by(value, F.col("client")))
        kept = [F.bool_and("is_float").alias("is_float")]
    else:
        result, kept = total, []
    merged = weighted.groupBy("name", "pos").agg(
        result.alias("value"), F.count(F.lit(1)).alias("__clients"), *kept
    )
    flags = ["is_float"] if kept else []
    return merged.select("name", "pos", _checked(merged, n_clients).cast(kind).alias("value"), *flags)


def alignment_errors(parameters: DataFrame) -> DataFrame:
    """(client, name, pos) a client lacks although another reports it."""
    everyone = parameters.agg(F.collect_set("client").alias("clients")).scalar()
    reporting = parameters.groupBy("name", "pos").agg(F.collect_set("client").alias("__have"))
    return reporting.select(
        F.explode(F.array_except(everyone, F.col("__have"))).alias("client"), "name", "pos"
    )


def fedprox_penalty(parameters: DataFrame, reference: DataFrame, mu: float) -> DataFrame:
    """mu / 2 times the squared distance of each client from the reference, floats only.

    A parameter that only one side knows fails the job.
    """
    if mu < 0:
        raise ValueError(f"mu must be non-negative, got {mu}")
    floats = parameters.where("is_float") if "is_float" in parameters.columns else parameters
    local = floats.select("client", "name", "pos", F.col("value").cast("double").alias("__local"))
    shared = reference.select("name", "pos", F.col("value").cast("double").alias("__shared"))
    if "is_float" in reference.columns:
        shared = reference.where("is_float").select(
            "name", "pos", F.col("value").cast("double").alias("__shared")
        )
    size = shared.agg(F.count(F.lit(1)).alias("n")).scalar()
    bad = F.raise_error(F.lit("local and reference parameters do not match"))
    difference = F.col("__local") - F.col("__shared")
    return (
        local.join(shared, ["name", "pos"], "left")
        .groupBy("client")
        .agg(
            F.sum(difference * difference).alias("__sum"),
            F.count("__shared").alias("__matched"),
            F.count(F.lit(1)).alias("__n"),
        )
        .select(
            "client",
            F.when(
                (F.col("__matched") != size) | (F.col("__n") != size), bad.cast("double")
            )
            .otherwise(F.col("__sum") * (mu / 2.0))
            .alias("penalty"),
        )
    )
