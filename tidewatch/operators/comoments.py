"""Means and co-moments of many columns in one pass, merged like a tree.

Each task folds its rows into (n, means, sums of products of deviations). Two such summaries merge
exactly in the same way whatever their sizes, so neither the number of rows, nor uneven partitions,
nor values far from 0 cost digits. Summaries of many tasks meet in groups of ``FAN`` until few are left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

#: Summaries that one task merges.
FAN = 16
#: What the last summaries may hold when the driver merges them.
DRIVER_BYTES = 16 << 20
SCHEMA = "task long, n long, mean array<double>, moment array<double>, low array<double>, high array<double>"


@dataclass(frozen=True)
class CoMoments:
    """``moment[i, j]``: the sum over rows of the product of both columns' deviations."""

    n: int
    mean: np.ndarray
    moment: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> CoMoments:
        # From the first row on, so that values far from 0 do not eat up the digits of their sum.
        shifted = rows - rows[0]
        mean = shifted.mean(axis=0)
        away = shifted - mean
        return cls(len(rows), rows[0] + mean, away.T @ away, rows.min(axis=0), rows.max(axis=0))

    def merged(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return CoMoments(
            n,
            self.mean + gap * (other.n / n),
            self.moment + other.moment + np.outer(gap, gap) * (self.n * other.n / n),
            np.minimum(self.low, other.low),
            np.maximum(self.high, other.high),
        )

    def correlation(self) -> np.ndarray:
        """Pearson's r; 0 where a column is constant, 1 on the diagonal."""
        spread = np.sqrt(np.diag(self.moment))
        # A constant is known by its extremes; merged moments leave noise to divide by.
        varies = (self.low < self.high) & (spread > 0)
        scale = np.where(varies, spread, 1.0)
        r = np.where(np.outer(varies, varies), self.moment / scale / scale[:, None], 0.0)
        np.fill_diagonal(r, 1.0)
        return np.clip(r, -1.0, 1.0)


def _fold(parts: Iterable[CoMoments]) -> CoMoments | None:
    """Neighbours merge first, so that summaries of like size meet."""
    waiting: list[tuple[int, CoMoments]] = []
    for part in parts:
        height = 0
        while waiting and waiting[-1][0] == height:
            part, height = waiting.pop()[1].merged(part), height + 1
        waiting.append((height, part))
    found = None
    for _, part in reversed(waiting):
        found = part if found is None else part.merged(found)
    return found


def _row(task: int, found: CoMoments) -> dict[str, list]:
    return {
        "task": [task], "n": [found.n], "mean": [found.mean.tolist()], "moment": [found.moment.ravel().tolist()],
        "low": [found.low.tolist()], "high": [found.high.tolist()],
    }


def _parts(table: pa.Table) -> Iterator[CoMoments]:
    for row in table.sort_by("task").to_pylist():
        width = len(row["mean"])
        moment = np.array(row["moment"]).reshape(width, width)
        yield CoMoments(row["n"], *(np.array(row["mean"]), moment), np.array(row["low"]), np.array(row["high"]))


def co_moments(df: DataFrame, values: Column, width: int, far: bool = False) -> CoMoments | None:
    """The summary of the number arrays ``values``, ``width`` long and finite; None without rows.

    With ``far``, for values that may lie far from 0 compared with their spread, everything is measured
    from some row of the table; means are then relative to that row.
    """
    origin = df.select(values.cast("array<double>").alias("v")).first() if far else None
    base = np.array(origin["v"]) if origin else np.zeros(width)
    schema = pa.schema({"task": pa.int64(), "n": pa.int64()} | {
        name: pa.list_(pa.float64()) for name in ("mean", "moment", "low", "high")
    })

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _fold(
            CoMoments.of(batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width) - base)
            for batch in batches if batch.num_rows
        )
        if found is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(_row(task, found), schema=schema)

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(_row(key[0].as_py(), _fold(_parts(rows))), schema=schema)

    spark = df.sparkSession
    parts = df.select(values.cast("array<double>").alias("v")).mapInArrow(summarise, SCHEMA)
    parts = cut_lineage(spark, parts, "co-moments")
    few = max(1, DRIVER_BYTES // (8 * width * (width + 3)))
    while parts.count() > few:
        group = F.floor(F.col("task") / FAN).cast("long").alias("group")
        parts = cut_lineage(spark, parts.groupBy(group).applyInArrow(merge, SCHEMA), "co-moments")
    return _fold(_parts(parts.toArrow()))


def correlations(
    df: DataFrame, values: Column, names: Sequence[str], far: bool = False
) -> list[tuple[str, str, float]]:
    """(a, b, r) of all pairs of ``names``, the components of ``values``: a number for each pair."""
    found = co_moments(df, values, len(names), far)
    matrix = np.eye(len(names)) if found is None else found.correlation()
    return [(a, b, float(matrix[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)]
