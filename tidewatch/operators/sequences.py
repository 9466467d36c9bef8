"""Runs, segments and fixed-length windows over ordered rows.

Input rows have a ``source`` and an integer ``pos`` unique within it. Two rows are neighbours
when their positions differ by one, so a filtered-out row breaks a run by itself. Every frame
below spans at most one chunk plus its halo, however long a source or run is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import (
    CHUNK_BITS,
    running,
    running_max,
    running_sum,
    sliding,
    with_halo,
)


def _check_window(window: int) -> None:
    if window <= 0:
        raise ValueError(f"window must be positive, got {window}")


def _marked_starts(
    df: DataFrame, source: str, pos: str, same: Sequence[str], bits: int
) -> DataFrame:
    """Add ``__start``: no neighbour before, or one that differs in ``same``."""
    order = sliding([source], pos)
    joined = F.lag(pos).over(order) == F.col(pos) - 1
    for name in same:
        joined = joined & F.lag(name).over(order).eqNullSafe(F.col(name))
    return (
        with_halo(df, pos, 1, bits)
        .withColumn("__start", ~F.coalesce(joined, F.lit(False)))
        .where(~F.col("__halo"))
        .drop("__halo")
    )


def with_run_start(
    df: DataFrame,
    source: str,
    pos: str,
    same: Sequence[str],
    start: str = "run_start",
    number: str | None = None,
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add the first position of the row's run and, on request, the run's number in its source."""
    marked = _marked_starts(df, source, pos, same, bits)
    outputs = {start: running_max(F.when(F.col("__start"), F.col(pos)))}
    if number is not None:
        outputs["__number"] = running_sum(F.col("__start").cast("long"))
    out = running(marked, [source], [F.col(pos)], [F.col("__chunk")], outputs, 1 << bits)
    if number is None:
        return out.select(*df.columns, start)
    return out.select(*df.columns, start, (F.col("__number") - 1).alias(number))


def contiguity_segments(
    df: DataFrame, source: str, pos: str, bits: int = CHUNK_BITS
) -> DataFrame:
    """Add ``segment_start`` and ``segment_id``: a new segment at every gap in ``pos``."""
    return with_run_start(df, source, pos, [], "segment_start", "segment_id", bits)


def runs(
    df: DataFrame, source: str, pos: str, label: str, bits: int = CHUNK_BITS
) -> DataFrame:
    """Maximal stretches of neighbours with one label, one row each."""
    rows = with_run_start(
        df.select(source, pos, label), source, pos, [label], bits=bits
    )
    return rows.groupBy(source, "run_start").agg(
        F.max(pos).alias("run_end"),
        F.first(label).alias(label),
        F.count(F.lit(1)).alias("run_length"),
    )


def count_sequences(run_table: DataFrame, window: int) -> DataFrame:
    """How many windows the runs hold: the sum of max(0, length - window + 1)."""
    _check_window(window)
    fits = F.greatest(F.lit(0), F.col("run_length") - window + 1)
    return run_table.agg(F.coalesce(F.sum(fits), F.lit(0)).alias("n_sequences"))


def train_windows(
    df: DataFrame,
    source: str,
    pos: str,
    label: str,
    features: Sequence[str],
    window: int,
    keep: Sequence[str] = (),
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Every length-``window`` slice inside one run, as ``window`` rows of float features.

    One row per slice, keyed by its last record, whose label it takes. ``keep`` carries further
    columns of the last record.
    """
    _check_window(window)
    order = sliding([source], pos)
    frame = order.rowsBetween(-(window - 1), 0)
    whole = (
        (F.lag(pos, window - 1).over(order) == F.col(pos) - (window - 1))
        if window > 1
        else F.lit(True)
    )
    record = F.array(*[F.col(c).cast("float") for c in features])
    needed = list(dict.fromkeys([source, pos, label, *keep, *features]))
    return (
        with_halo(df.select(*needed), pos, window - 1, bits)
        .withColumns(
            {
                "__whole": whole,
                "__low": F.min(label).over(frame),
                "__high": F.max(label).over(frame),
                "window": F.collect_list(record).over(frame),
            }
        )
        .where(~F.col("__halo") & F.col("__whole") & (F.col("__low") == F.col("__high")))
        .select(source, pos, label, *keep, "window")
    )


def latency_windows(
    df: DataFrame,
    source: str,
    pos: str,
    label: str,
    features: Sequence[str],
    window: int,
    benign_label,
    keep: Sequence[str] = (),
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Evaluation-only windows across a benign-to-attack boundary.

    A window qualifies when it holds exactly one label change, from a benign run to an attack
    run, which also keeps it inside those two runs. ``past`` counts its attack records.
    """
    _check_window(window)
    order = sliding([source], pos)
    frame = order.rowsBetween(-(window - 1), 0)
    # Changes into any record but the first of the frame.
    inner = order.rowsBetween(-max(window - 2, 0), 0)
    changed = (F.lag(pos).over(order) == F.col(pos) - 1) & (
        F.lag(label).over(order) != F.col(label)
    )
    record = F.array(*[F.col(c).cast("float") for c in features])
    needed = list(dict.fromkeys([source, pos, label, *keep, *features]))
    return (
        with_halo(df.select(*needed), pos, window - 1, bits)
        .withColumn("__changed", F.coalesce(changed, F.lit(False)))
        .withColumns(
            {
                "__whole": F.lag(pos, window - 1).over(order) == F.col(pos) - (window - 1),
                "__changes": F.sum(F.col("__changed").cast("int")).over(inner),
                "boundary": F.max(F.when(F.col("__changed"), F.col(pos))).over(inner),
                "__first": F.first(label).over(frame),
                "window": F.collect_list(record).over(frame),
            }
        )
        .where(
            F.lit(window > 1)
            & ~F.col("__halo")
            & F.col("__whole")
            & (F.col("__changes") == 1)
            & (F.col("__first") == benign_label)
            & (F.col(label) != benign_label)
        )
        .select(
            source,
            pos,
            label,
            *keep,
            "boundary",
            (F.col(pos) - F.col("boundary") + 1).alias("past"),
            "window",
        )
    )


def detection_latency(windows: DataFrame, source: str, malicious: str) -> DataFrame:
    """Per boundary, the records into the attack until the verdict flips; null if it never does."""
    return windows.groupBy(source, "boundary").agg(
        F.min(F.when(F.col(malicious), F.col("past"))).alias("latency")
    )


def final_record(window: str = "window"):
    """The record a window's label refers to."""
    return F.element_at(window, -1)
