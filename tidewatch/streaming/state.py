"""Keyed state: a sliding window per device and a replay guard per (edge, device)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.functions.metadata import COUNTER_TYPE, decode_metadata
from tidewatch.operators.routing import EDGE_MISMATCH, MALFORMED, REPLAY

REPLAY_SCHEMA = "edge_id string, device_id string, stream_index long, accepted boolean"


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of one micro-batch by arrival; the trigger bounds their number."""
    parts = list(rows)
    batch = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    return batch.sort_values("stream_index")


class _Windows(StatefulProcessor):
    """State: the last window - 1 records, and how full the buffer is."""

    def __init__(self, window: int, keep: list[str]) -> None:
        self._window = window
        self._keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getListState("last", "features array<double>")
        self._depth = handle.getValueState("depth", "depth int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # A window of one needs no history but still remembers the feature count.
        history = max(self._window - 1, 1)
        held = [list(r[0]) for r in self._last.get()] if self._last.exists() else []
        depth = self._depth.get()[0] if self._depth.exists() else 0
        batch = _in_order(rows)
        resets = np.flatnonzero(batch["reset"].to_numpy(bool))
        records = batch["features"].to_numpy()
        emitted, windows = [], []
        # Stretches between resets; each but the first begins with an empty buffer.
        for begin, end in zip([0, *(resets + 1)], [*resets, len(batch)], strict=True):
            if begin:
                held, depth = [], 0
            if begin == end:
                continue
            own = _stacked(key[0], [*held, *records[begin:end]])
            n, first = end - begin, len(own) - (end - begin)
            if self._window == 1:
                own, first = own[first:], 0
            if len(own) >= self._window:
                found = np.lib.stride_tricks.sliding_window_view(own, self._window, axis=0)
                windows += list(found.transpose(0, 2, 1).tolist())
                emitted += range(begin + self._window - 1 - first, end)
            held, depth = own[-history:].tolist(), min(self._window, depth + n)
        if held:
            self._last.put([(r,) for r in held])
            self._depth.update((depth,))
        else:
            self._last.clear()
            self._depth.clear()
        if windows:
            yield batch.iloc[emitted][["device", "stream_index", *self._keep]].assign(
                window=windows
            )

    def close(self) -> None:
        pass


def _stacked(device, records: list) -> np.ndarray:
    widths = {len(r) for r in records}
    if len(widths) > 1:
        first = len(records[0])
        other = next(w for w in map(len, records) if w != first)
        raise ValueError(f"device {device!r}: expected {first} features, got {other}")
    return np.array([np.asarray(r, float) for r in records])


def stream_windows(messages: DataFrame, window: int, keep: Sequence[str] = ()) -> DataFrame:
    """Windows of the last ``window`` records per device, from the ``window``-th record on.

    ``messages``: device, stream_index, features and optionally ``reset``; a reset row clears the
    device's buffer and emits nothing. ``keep`` carries further columns of the last record.
    """
    if window <= 0:
        raise ValueError(f"window must be positive, got {window}")
    reset = F.col("reset") if "reset" in messages.columns else F.lit(False)
    rows = messages.select(
        "device",
        "stream_index",
        F.col("features").cast("array<double>").alias("features"),
        F.coalesce(reset, F.lit(False)).alias("reset"),
        *keep,
    )
    schema = rows.select("device", "stream_index", *keep).schema.add(
        "window", T.ArrayType(T.ArrayType(T.DoubleType()))
    )
    return rows.groupBy("device").transformWithStateInPandas(
        statefulProcessor=_Windows(window, list(keep)),
        outputStructType=schema,
        outputMode="Append",
        timeMode="None",
    )


class _Replay(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self._highest = handle.getValueState("highest", f"counter {COUNTER_TYPE}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows)
        held = self._highest.get()
        highest = None if held is None else int(held[0])
        # Counters may pass a long, so these are arrays of whole numbers of any size.
        counters = np.array([int(c) for c in batch["counter"]], object)
        if (counters < 0).any():
            raise ValueError(f"counter must be non-negative, got {counters.min()}")
        # Only an accepted counter can raise the maximum of all before it.
        before = np.maximum.accumulate(np.array([-1 if highest is None else highest, *counters], object))
        accepted = (counters > before[:-1]).astype(bool)
        highest = int(before[-1])
        self._highest.update((Decimal(highest),))
        yield pd.DataFrame(
            {
                "edge_id": key[0],
                "device_id": key[1],
                "stream_index": batch["stream_index"].to_numpy(),
                "accepted": accepted,
            }
        )

    def close(self) -> None:
        pass


def stream_replay_guard(messages: DataFrame) -> DataFrame:
    """Accept a message iff its counter is above the last accepted one of its (edge, device).

    ``messages``: edge_id, device_id, stream_index, counter.
    """
    rows = messages.select(
        "edge_id", "device_id", "stream_index", F.col("counter").cast(COUNTER_TYPE).alias("counter")
    )
    return rows.groupBy("edge_id", "device_id").transformWithStateInPandas(
        statefulProcessor=_Replay(),
        outputStructType=REPLAY_SCHEMA,
        outputMode="Append",
        timeMode="None",
    )


def _state(spark: SparkSession, progress: str, variable: str) -> DataFrame:
    """(partition_id, key, value) of a state variable, as of the last finished micro-batch."""
    return spark.read.format("statestore").option("stateVarName", variable).load(progress)


def stream_depth(spark: SparkSession, progress: str) -> DataFrame:
    """(device, depth): how full each device's buffer is, read from the state of :func:`stream_windows`.

    ``progress`` is the checkpoint folder of its query, which may be running.
    """
    return _state(spark, progress, "depth").select("key.device", "value.depth")


def stream_last_seen(spark: SparkSession, progress: str) -> DataFrame:
    """(edge_id, device_id, last_counter): the last accepted counter in the state of
    :func:`stream_replay_guard`."""
    return _state(spark, progress, "highest").select(
        "key.edge_id", "key.device_id", F.col("value.counter").alias("last_counter")
    )


def stream_cloud_accept(deliveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rejected at once, verdicts of the replay guard) for edge_id, stream_index, metadata.

    Malformed metadata and edge mismatches are turned away without state; only the rest reaches
    the guard, whose refusals carry ``reject_reason = 'replay'``.
    """
    # As the row of a generator the bytes are decoded once; a filter on a plain column would copy the decoding
    # into itself, once for each place that names it.
    parsed = deliveries.select("*", F.explode(F.array(decode_metadata(F.col("metadata")))).alias("__meta"))
    reason = F.when(F.col("__meta").isNull(), F.lit(MALFORMED)).when(
        F.col("__meta.edge_id") != F.col("edge_id"), F.lit(EDGE_MISMATCH)
    )
    judged = parsed.withColumn("reject_reason", reason)
    rejected = judged.where(F.col("reject_reason").isNotNull()).select(
        "edge_id", "stream_index", "reject_reason"
    )
    survivors = judged.where(F.col("reject_reason").isNull()).select(
        "edge_id",
        F.col("__meta.device_id").alias("device_id"),
        "stream_index",
        F.col("__meta.counter").alias("counter"),
    )
    guarded = stream_replay_guard(survivors).select(
        "edge_id",
        "stream_index",
        F.when(~F.col("accepted"), F.lit(REPLAY)).alias("reject_reason"),
    )
    return rejected, guarded
