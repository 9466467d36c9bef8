"""Parquet tables and the roles they play."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.ordering import by_position, position_chunk, running, running_count


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The ordered stream: ``event_id`` is the arrival order, ``k`` a second feature."""
    return table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("source"),
        F.col("event_type").alias("label"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def sourced_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with ``pos``, the 0-based position within their source."""
    return by_position(
        events(spark, folder), ["source"], "event_id", {"pos": running_count(inclusive=False)}
    )


def pooled_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events pooled class by class: ``pos`` is dense over (label, event_id)."""
    return pooled(events(spark, folder), "label", "event_id")


def pooled(df: DataFrame, label: str, order: str) -> DataFrame:
    """Number rows class by class, in ``order`` within a class."""
    return running(
        df,
        [],
        [F.col(order)],
        [F.col(label), position_chunk(order)],
        {"pos": running_count(inclusive=False)},
    )
