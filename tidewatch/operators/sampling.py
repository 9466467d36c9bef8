"""Class caps and seeded samples that keep row order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.draws import draw
from tidewatch.operators.ordering import draw_cutoffs, null_safe_join


def pool(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, matched by column name."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def _keep_smallest(df: DataFrame, keys: list[str], seed: int, row_id: str, cap: int) -> DataFrame:
    if cap <= 0:
        raise ValueError(f"the cap must be positive, got {cap}")
    order = draw(seed, row_id)
    cutoffs = draw_cutoffs(df, keys, order, lambda n: F.array(F.least(n, F.lit(cap))))
    if keys:
        joined = null_safe_join(df, cutoffs, keys)
        return joined.where(order <= F.col("cutoffs")[0]).select(*df.columns)
    # A sample of the whole table has one cutoff, a single value.
    found = cutoffs.first()
    return df.limit(0) if not (found and found["cutoffs"]) else df.where(order <= F.lit(found["cutoffs"][0]))


def trim_to_cap(df: DataFrame, label: str, row_id: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each class, drawn by seed; the rows keep their positions."""
    return _keep_smallest(df, [label], seed, row_id, cap)


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows (or all), drawn uniformly by seed."""
    return _keep_smallest(df, [], seed, row_id, n)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
