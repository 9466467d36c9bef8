"""From a frame of labelled rows to scaled training sequences, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidewatch.functions.expressions import finite_rows
from tidewatch.functions.taxonomy import with_family
from tidewatch.operators.ordering import CHUNK_BITS
from tidewatch.operators.scaling import Scaler
from tidewatch.operators.sequences import train_windows


def prepared_sequences(
    df: DataFrame,
    source: str,
    pos: str,
    label: str,
    features: Sequence[str],
    window: int,
    scaler: Scaler,
    taxonomy: DataFrame | None = None,
    keep: Sequence[str] = (),
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """Drop non-finite rows, scale, map labels to class indexes and build windows.

    A dropped row leaves a gap in ``pos``, so no window reaches across it.
    """
    scaled = scaler.transform(finite_rows(df, features))
    classed = with_family(scaled, label, taxonomy)
    return train_windows(
        classed, source, pos, "class_index", features, window, keep=keep, bits=bits
    )
