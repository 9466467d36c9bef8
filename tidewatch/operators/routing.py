"""Verdict routing over message tables: the batch twins of the streaming jobs.

Messages carry ``stream_index``, the arrival order over all devices. Per-device state becomes a
chunked running result, so a device that sends a third of all messages is still spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.draws import draw
from tidewatch.functions.expressions import alert_reason, finite_rows, require_columns
from tidewatch.functions.metadata import COUNTER_TYPE, decode_metadata
from tidewatch.operators.ordering import (
    CHUNK_BITS,
    DRAW_PREFIX,
    by_position,
    running,
    running_count,
    running_max,
    sliding,
    with_halo,
)
from tidewatch.operators.scaling import Scaler

MALFORMED, EDGE_MISMATCH, REPLAY = "malformed", "edge_mismatch", "replay"


def device_counter(
    df: DataFrame, device: str, order: str, counter: str = "counter", bits: int = CHUNK_BITS
) -> DataFrame:
    """Add the device's own counter, from 0 in arrival order."""
    return by_position(df, [device], order, {counter: running_count(inclusive=False)}, bits)


def device_windows(
    df: DataFrame,
    device: str,
    counter: str,
    features: Sequence[str],
    window: int,
    keep: Sequence[str] = (),
    buffering: bool = False,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Per device, the last ``window`` records at every record from the ``window``-th on.

    ``counter`` is the dense per-device counter. With ``buffering`` the earlier records are kept
    too, without a window.
    """
    if window <= 0:
        raise ValueError(f"window must be positive, got {window}")
    frame = sliding([device], counter).rowsBetween(-(window - 1), 0)
    record = F.array(*[F.col(c).cast("double") for c in features])
    needed = list(dict.fromkeys([device, counter, *keep, *features]))
    full = F.col(counter) >= window - 1
    return (
        with_halo(df.select(*needed), counter, window - 1, bits)
        .withColumn("window", F.collect_list(record).over(frame))
        .where(~F.col("__halo") & (F.lit(buffering) | full))
        .select(device, counter, *keep, F.when(full, F.col("window")).alias("window"))
    )


def buffer_depth(counter: str, window: int) -> Column:
    """How many records the device's buffer holds after this one."""
    return F.least(F.col(counter) + 1, F.lit(window))


# --- pairing with held-out records ------------------------------------------------------------


def held_out_pool(
    df: DataFrame, source: str, pos: str, features: Sequence[str], scaler: Scaler, label: str
) -> DataFrame:
    """Scaled, finite held-out records with their reference ``source:pos`` and label."""
    require_columns(df, [source, pos, label, *features])
    scaled = scaler.transform(finite_rows(df, features))
    return scaled.select(
        F.concat_ws(":", F.col(source).cast("string"), F.col(pos).cast("string")).alias("ref"),
        F.col(label).alias("true_label"),
        *[F.col(f).cast("float").alias(f) for f in features],
    )


def pool_slots(pool: DataFrame, seed: int) -> DataFrame:
    """Add ``slot``, the record's 0-based place in a permutation fixed by ``seed``."""
    drawn = pool.withColumn("__draw", draw(seed, "ref"))
    return running(
        drawn,
        [],
        [F.col("__draw")],
        [F.substring("__draw", 1, DRAW_PREFIX)],
        {"slot": running_count(inclusive=False)},
    ).drop("__draw")


def pair_held_out(
    messages: DataFrame, slots: DataFrame, pool_size: int, stream_index: str = "stream_index"
) -> DataFrame:
    """Join each message to the record at slot ``stream_index mod pool_size``.

    The global stream index is the key: device counters restart and would collide. Also joins a
    stream of messages to the fixed pool.
    """
    if pool_size <= 0:
        raise ValueError("the held-out pool is empty")
    negative = F.raise_error(F.lit("stream_index must be non-negative")).cast("long")
    slot = F.when(F.col(stream_index) >= 0, F.col(stream_index) % pool_size).otherwise(negative)
    return messages.withColumn("slot", slot).join(slots, "slot")


# --- verdicts and routes ----------------------------------------------------------------------


def route(df: DataFrame, malicious: str) -> DataFrame:
    """Add ``path``: every message goes to exactly one of 'cloud' and 'alert'."""
    return df.withColumn(
        "path", F.when(F.col(malicious), F.lit("alert")).otherwise(F.lit("cloud"))
    )


def cloud_messages(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("path") == "cloud")


def alert_messages(routed: DataFrame) -> DataFrame:
    return routed.where(F.col("path") == "alert")


def _accepts(counter: Column, highest: Column) -> Column:
    return highest.isNull() | (counter > highest)


def replay_accept(
    df: DataFrame, keys: Sequence[str], order: str, counter: str, bits: int = CHUNK_BITS
) -> DataFrame:
    """Add ``accepted``: the counter is above every earlier one of its key.

    A rejected counter is never above the highest accepted one, so the running maximum over all
    earlier rows equals the guard's last accepted counter. A negative counter fails the job.
    """
    negative = F.raise_error(F.lit("counter must be non-negative")).cast("boolean")
    guarded = by_position(
        df, keys, order, {"__highest": running_max(F.col(counter), inclusive=False)}, bits
    )
    accepted = F.when(F.col(counter) < 0, negative).otherwise(
        _accepts(F.col(counter), F.col("__highest"))
    )
    return guarded.withColumn("accepted", accepted).drop("__highest")


def last_accepted(df: DataFrame, keys: Sequence[str], counter: str) -> DataFrame:
    """The guard's state after these messages: the highest counter of each key."""
    return df.groupBy(*keys).agg(F.max(counter).alias("last_counter"))


def cloud_accept(
    df: DataFrame, edge: str, metadata: str, order: str, bits: int = CHUNK_BITS
) -> DataFrame:
    """Add ``reject_reason``, null where the cloud accepts the message.

    Checked in order: the metadata parses, its edge is the sender's, its counter is not a replay.
    Only messages that pass the first two reach the replay state.
    """
    parsed = df.withColumn("__meta", decode_metadata(F.col(metadata))).withColumns(
        {
            "__valid": F.coalesce(F.col("__meta.edge_id") == F.col(edge), F.lit(False)),
            "__device": F.coalesce(F.col("__meta.device_id"), F.lit("")),
        }
    )
    seen = F.when(F.col("__valid"), F.col("__meta.counter").cast(COUNTER_TYPE))
    guarded = by_position(
        parsed,
        [edge, "__device", "__valid"],
        order,
        {"__highest": running_max(seen, inclusive=False)},
        bits,
    )
    reason = (
        F.when(F.col("__meta").isNull(), F.lit(MALFORMED))
        .when(~F.col("__valid"), F.lit(EDGE_MISMATCH))
        .when(~_accepts(F.col("__meta.counter"), F.col("__highest")), F.lit(REPLAY))
    )
    return guarded.withColumn("reject_reason", reason).select(*df.columns, "reject_reason")


def alert_log(
    alerts: DataFrame, edge: str, device: str, counter: str, order: str, bits: int = CHUNK_BITS
) -> DataFrame:
    """(edge, sequence, reason) in arrival order, numbered from 1 over the whole log."""
    empty = F.raise_error(F.lit("edge_id must be non-empty")).cast("string")
    named = alerts.withColumn(
        edge, F.when(F.length(edge) > 0, F.col(edge)).otherwise(empty)
    )
    numbered = by_position(named, [], order, {"sequence": running_count()}, bits)
    return numbered.select(
        order, edge, "sequence", alert_reason(F.col(device), F.col(counter)).alias("reason")
    )


def run_counts(messages: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of run counters over (classified, malicious, reject_reason) messages and the alert log."""
    raised = alerts.agg(F.count(F.lit(1)).alias("n")).scalar()
    benign = F.col("classified") & ~F.col("malicious")
    return messages.agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(~F.col("classified")).alias("n_buffering"),
        F.count_if("classified").alias("n_classified"),
        F.count_if(benign).alias("n_benign"),
        F.count_if(F.col("classified") & F.col("malicious")).alias("n_malicious"),
        F.count_if(benign & F.col("reject_reason").isNull()).alias("cloud_received"),
        F.count_if(benign & F.col("reject_reason").isNotNull()).alias("cloud_rejected"),
    ).withColumn("alerts", raised)


def count_errors(counts: DataFrame) -> DataFrame:
    """The rows of run counters that do not add up: every message buffered or classified, every benign
    one answered by the cloud, every malicious one in the alert log. The gate wants none."""
    return counts.where(
        "n_buffering + n_classified <> n_messages OR n_benign + n_malicious <> n_classified"
        " OR cloud_received + cloud_rejected <> n_benign OR alerts <> n_malicious"
    )


def leaked_to_cloud(cloud: DataFrame, verdicts: DataFrame, message_id: str) -> DataFrame:
    """How many malicious messages are in the cloud table; the gate wants 0."""
    malicious = verdicts.where("malicious").select(message_id)
    return cloud.join(malicious, message_id, "left_semi").agg(
        F.count(F.lit(1)).alias("n_leaked")
    )


def label_agreement(df: DataFrame, malicious: str, true_benign: Column) -> DataFrame:
    """Share of verdicts that agree with the true label; a report, never an input."""
    agrees = (~F.col(malicious)) == true_benign
    return df.agg(F.avg(agrees.cast("double")).alias("agreement"))
