"""The runtime job: pair messages with held-out records, window, score, route, accept."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.metadata import encode_metadata
from tidewatch.functions.taxonomy import BENIGN_INDEX
from tidewatch.operators.models import score_with
from tidewatch.operators.routing import alert_log, cloud_accept, pair_held_out
from tidewatch.streaming import jobs
from tidewatch.streaming.state import stream_windows

CARRIED = ["edge", "counter", "true_label"]


def verdict_stream(
    messages: DataFrame,
    slots: DataFrame,
    pool_size: int,
    features: Sequence[str],
    window: int,
    scorer: Callable[[np.ndarray], np.ndarray],
) -> DataFrame:
    """Verdicts of a stream of (device, stream_index, edge, counter) messages.

    The features come from the held-out pool alone, never from the message. The true label rides
    along for the report; the scorer sees the window only.
    """
    paired = pair_held_out(messages, slots, pool_size).withColumn(
        "features", F.array(*[F.col(f).cast("double") for f in features])
    )
    windows = stream_windows(paired, window, CARRIED)
    scored = score_with(scorer, windows, ["device", "stream_index", *CARRIED], len(features))
    return scored.withColumn("malicious", F.col("prediction") != BENIGN_INDEX)


def counters() -> list[Column]:
    """What a micro-batch of verdicts counts while it passes."""
    return [
        F.count(F.lit(1)).alias("n_classified"),
        F.count_if(~F.col("malicious")).alias("n_benign"),
        F.count_if("malicious").alias("n_malicious"),
    ]


@dataclass(frozen=True)
class DetectionRun:
    """The tables one run leaves behind; ``counters`` has a row for each micro-batch of verdicts."""

    verdicts: DataFrame
    cloud: DataFrame
    alerts: DataFrame
    counters: DataFrame

    def counts(self, n_messages: int) -> DataFrame:
        """One row: buffering, classified, benign, malicious, received, rejected, alerts.

        Verdicts are counted as they passed, deliveries in the tables of their routes.
        """
        classified = self.counters.agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_classified", "n_benign", "n_malicious")]
        )
        received = self.cloud.agg(
            F.count_if(F.col("reject_reason").isNull()).alias("received"),
            F.count_if(F.col("reject_reason").isNotNull()).alias("rejected"),
        )
        return classified.select(
            F.lit(n_messages).cast("long").alias("n_messages"),
            (F.lit(n_messages) - F.col("n_classified")).alias("n_buffering"),
            "n_classified",
            "n_benign",
            "n_malicious",
            received.select("received").scalar().alias("cloud_received"),
            received.select("rejected").scalar().alias("cloud_rejected"),
            self.alerts.agg(F.count(F.lit(1))).scalar().alias("alerts"),
        )


def run_detection(verdicts: DataFrame, folder: str, schema_version: str) -> DetectionRun:
    """Run a verdict stream to its end and deliver both routes.

    The stateful part runs once, into the verdict table. Two jobs then follow that table, one per
    route; the alert job is not given anything of the cloud's.
    """
    judged = jobs.run_to_table(verdicts, f"{folder}/verdicts", counters())
    spark = judged.sparkSession

    def deliver(batch: DataFrame, batch_id: int) -> None:
        metadata = encode_metadata(
            F.col("edge"), F.col("device"), F.col("counter"), F.lit(schema_version)
        )
        jobs.to_parquet(f"{folder}/cloud")(
            batch.select("stream_index", "edge", metadata.alias("metadata")), batch_id
        )

    def follow() -> DataFrame:
        # A micro-batch of verdicts leaves a file for each state partition.
        return jobs.file_stream(
            spark, f"{folder}/verdicts/rows", judged.schema, files_per_batch=None
        )

    routes = [
        jobs.start_cloud_route(follow(), deliver, f"{folder}/cloud-progress"),
        jobs.start_alert_route(
            follow(), jobs.to_parquet(f"{folder}/alert"), f"{folder}/alert-progress"
        ),
    ]
    for query in routes:
        query.awaitTermination()
    cloud = _delivered(
        spark, f"{folder}/cloud", "stream_index long, edge string, metadata binary"
    )
    alerts = _delivered(spark, f"{folder}/alert", judged.schema)
    return DetectionRun(
        judged,
        cloud_accept(cloud, "edge", "metadata", "stream_index"),
        alert_log(alerts, "edge", "device", "counter", "stream_index"),
        _delivered(
            spark, f"{folder}/verdicts/counters", "n_classified long, n_benign long, n_malicious long"
        ),
    )


def _delivered(spark, path: str, schema) -> DataFrame:
    """The batches a route wrote; without a single verdict it has written none."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
