"""Streaming sources, sinks and the two disjoint routes."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tidewatch.operators.routing import alert_messages, cloud_messages, route
from tidewatch.session import ROCKSDB_PROVIDER

Sink = Callable[[DataFrame, int], None]

#: How much of a table a micro-batch reads, one file at least. Small files share a batch, so that the number
#: of batches follows the size of a table, not the number of its files.
BATCH_BYTES = 32 << 20


def file_stream(
    spark: SparkSession,
    folder: str,
    schema,
    pattern: str = "*.parquet",
    files_per_batch: int | None = 1,
    bytes_per_batch: int = BATCH_BYTES,
) -> DataFrame:
    """Parquet files as a stream, a bounded number of files per micro-batch.

    With ``files_per_batch`` None, their bytes are bounded instead.
    """
    files = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch is None:
        return files.option("maxBytesPerTrigger", bytes_per_batch).parquet(folder)
    return files.option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def table_stream(
    spark: SparkSession, path: str, schema, files_per_batch: int | None = None
) -> DataFrame:
    """A parquet table as a stream, be it a folder of part files or a single file.

    A table that is not there fails at once, rather than giving a stream without rows.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        raise FileNotFoundError(path)
    if files.getFileStatus(place).isDirectory():
        return file_stream(spark, path, schema, "*.parquet", files_per_batch)
    return file_stream(spark, str(place.getParent()), schema, place.getName(), files_per_batch)


class CounterLog(StreamingQueryListener):
    """Writes the observed counters of each micro-batch of one query as a row of a table.

    A micro-batch that is run again after a failure replaces its row.
    """

    def __init__(self, spark: SparkSession, observation: str, path: str) -> None:
        self._spark, self._observation, self._path = spark, observation, path
        self._ended = threading.Event()
        self._failure: Exception | None = None
        self._run_id: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        observed = event.progress.observedMetrics.get(self._observation)
        if observed is None or self._failure is not None:
            return
        self._run_id = str(event.progress.runId)
        try:
            row = self._spark.createDataFrame([observed.asDict()])
            row.write.mode("overwrite").parquet(f"{self._path}/batch_id={event.progress.batchId}")
        except Exception as failure:  # noqa: BLE001 - raised again where the query is waited for
            self._failure = failure

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self._run_id in (None, str(event.runId)):
            self._ended.set()

    def wait(self, seconds: float = 60.0) -> None:
        """Until the events of the query that has ended are written."""
        if not self._ended.wait(seconds):
            raise TimeoutError("the counters of a stream that has ended did not arrive")
        if self._failure is not None:
            raise self._failure


def run_to_table(
    stream: DataFrame, folder: str, counters: Sequence[Column] = ()
) -> DataFrame:
    """Process all available input into a parquet table below ``folder`` and read it back.

    Progress, state and output live in the shared folder, so a restart resumes where it stopped.
    ``counters`` are named aggregates that are observed as rows pass; each micro-batch writes a row of
    them to the table ``counters`` below ``folder``.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    log = None
    observed = stream
    if counters:
        name = f"counters-{uuid.uuid4().hex}"
        observed = stream.observe(name, *counters)
        log = CounterLog(spark, name, f"{folder}/counters")
        spark.streams.addListener(log)
    try:
        query = (
            observed.writeStream.format("parquet")
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .start(f"{folder}/rows")
        )
        query.awaitTermination()
        if log is not None:
            log.wait()
    finally:
        if log is not None:
            spark.streams.removeListener(log)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def to_parquet(path: str) -> Sink:
    """A sink that writes one folder per micro-batch; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def start_cloud_route(verdicts: DataFrame, cloud: Sink, progress: str) -> StreamingQuery:
    """Hand benign messages to the cloud sink."""
    return _start(cloud_messages(route(verdicts, "malicious")), cloud, progress)


def start_alert_route(verdicts: DataFrame, alert: Sink, progress: str) -> StreamingQuery:
    """Hand malicious messages to the alert sink. This job is never given the cloud sink."""
    return _start(alert_messages(route(verdicts, "malicious")), alert, progress)


def _start(messages: DataFrame, sink: Sink, progress: str) -> StreamingQuery:
    return (
        messages.writeStream.foreachBatch(sink)
        .option("checkpointLocation", progress)
        .trigger(availableNow=True)
        .start()
    )
