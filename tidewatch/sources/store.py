"""Stores in the shared file system: prepared rows, run tables and model parameters.

Each write replaces exactly the partition of its own run or round, so a job that is started
again after a lost driver does not leave its rows twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE_SCHEMA = "run string, column string, stat string, value string"
METRICS_SCHEMA = (
    "run string, config string, seed long, model string, class string, metric string, value double"
)


def _replace_partition(df: DataFrame, path: str, *partitions: str) -> None:
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partitions)
        .parquet(path)
    )


def write_prepared(
    df: DataFrame, path: str, features: Sequence[str], scaled: bool = False
) -> None:
    """Prepared rows by split side, with the feature list beside them."""
    _replace_partition(df, f"{path}/rows", "side")
    columns = [(i, name, scaled) for i, name in enumerate(features)]
    df.sparkSession.createDataFrame(
        columns, "ordinal int, feature string, scaled boolean"
    ).coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def read_prepared(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], bool]:
    """(rows, features, scaled) as written; reading one side prunes the other."""
    listed = spark.read.parquet(f"{path}/features").orderBy("ordinal").collect()
    rows = spark.read.parquet(f"{path}/rows")
    features = [r["feature"] for r in listed]
    missing = [f for f in features if f not in rows.columns]
    if missing:
        raise ValueError(f"the prepared rows lack {missing}")
    return rows, features, bool(listed[0]["scaled"])


def write_selection(features: DataFrame, sweep: DataFrame | None, path: str) -> None:
    """The feature table of a selection, and the sweep if there was one, beside the prepared rows."""
    features.write.mode("overwrite").parquet(f"{path}/selection")
    if sweep is not None:
        sweep.write.mode("overwrite").parquet(f"{path}/sweep")


def read_selection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/selection")


def profile_rows(profile: DataFrame, run: str) -> DataFrame:
    """A profile as (run, column, stat, value)."""
    stats = [c for c in profile.columns if c != "column"]
    return profile.select(
        F.lit(run).alias("run"),
        "column",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(s).alias("stat"), F.col(s).cast("string").alias("value"))
                    for s in stats
                ]
            )
        ),
    )


def write_profile(profile: DataFrame, path: str, run: str) -> None:
    _replace_partition(profile_rows(profile, run), path, "run")


def metric_rows(
    metrics: DataFrame, run: str, config: str, seed: int, model: str, names: Sequence[str],
    class_column: str | None = None,
) -> DataFrame:
    """Metrics as (run, config, seed, model, class, metric, value)."""
    of_class = F.col(class_column).cast("string") if class_column else F.lit(None).cast("string")
    values = [
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ]
    return metrics.select(
        F.lit(run).alias("run"),
        F.lit(config).alias("config"),
        F.lit(seed).cast("long").alias("seed"),
        F.lit(model).alias("model"),
        of_class.alias("class"),
        F.inline(F.array(*values)),
    )


def write_metrics(rows: DataFrame, path: str) -> None:
    _replace_partition(rows, path, "run")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def save_parameters(
    parameters: DataFrame, path: str, round_id: int, metadata: dict[str, str]
) -> None:
    """One round's parameters (client, name, pos, value) and its text metadata."""
    _replace_partition(
        parameters.withColumn("round", F.lit(round_id)), f"{path}/parameters", "round"
    )
    rows = [(round_id, key, str(value)) for key, value in metadata.items()]
    _replace_partition(
        parameters.sparkSession.createDataFrame(rows, "round int, key string, value string"),
        f"{path}/metadata",
        "round",
    )


def read_metadata(spark: SparkSession, path: str, round_id: int) -> dict[str, str]:
    """A round's metadata, without touching its parameters."""
    rows = spark.read.parquet(f"{path}/metadata").where(F.col("round") == round_id).collect()
    return {r["key"]: r["value"] for r in rows}


def load_parameters(
    spark: SparkSession, path: str, round_id: int
) -> tuple[DataFrame, dict[str, str]]:
    table = spark.read.parquet(f"{path}/parameters").where(F.col("round") == round_id)
    return table.drop("round"), read_metadata(spark, path, round_id)


def sequence_count(metadata: dict[str, str], key: str = "n_k") -> int:
    """The stored sequence count; missing, garbled or negative is an error, never 0."""
    text = metadata.get(key)
    if text is None:
        raise ValueError(f"the parameters carry no {key}")
    try:
        count = int(text)
    except ValueError as error:
        raise ValueError(f"{key} is not a number: {text!r}") from error
    if count < 0:
        raise ValueError(f"{key} is negative: {count}")
    return count
