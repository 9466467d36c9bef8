"""Vectors in blocks of bounded size, and every block of one table against every block of another."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Query blocks that one task holds against one block of the other table.
TOGETHER = 8


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector of doubles): one row per id, without null and non-finite components.

    An id that comes with several different vectors takes part with the least of them. Rows
    without id take no part.
    """
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
        .where(fine)
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )


def dense(vectors: list[list[float]]) -> np.ndarray:
    """Rows of equal length; a shorter vector is filled up with zeros."""
    width = max(map(len, vectors), default=0)
    if all(len(v) == width for v in vectors):
        return np.array(vectors, float).reshape(len(vectors), width)
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def dealt(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """``df`` dealt evenly into partitions of about ``rows`` rows, and their number."""
    n = max(1, -(-df.count() // rows))
    return df.repartition(n), n


def as_blocks(df: DataFrame, make: Callable[[pa.Table], list[object]]) -> DataFrame:
    """(block, payload): what ``make`` returns for the rows of a partition, pickled.

    Blocks are numbered by partition; a partition gives one block, or several under one number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            made = make(pa.Table.from_batches(rows))
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([number] * len(made), pa.int32()), "payload": [pickle.dumps(x, 5) for x in made]}
            )

    return df.mapInArrow(run, "block int, payload binary")


def each_pair(
    left: DataFrame, n_left: int, right: DataFrame, n_right: int,
    work: Callable[[object, object], dict[str, list]], schema: pa.Schema, ddl: str,
) -> DataFrame:
    """``work(left payload, right payload)`` for all pairs of blocks.

    Right blocks go in bundles; a task holds one left block and one bundle at a time.
    """
    bundles = -(-n_right // TOGETHER)
    left = left.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))))
    right = right.select(
        F.floor(F.col("block") / TOGETHER).cast("int").alias("bundle"),
        "payload",
        F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))).alias("block"),
    )

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for a in left["payload"]:
            loaded = pickle.loads(a.as_py())
            for b in right["payload"]:
                parts.append(pa.Table.from_pydict(work(loaded, pickle.loads(b.as_py())), schema=schema))
        return pa.concat_tables(parts) if parts else schema.empty_table()

    return left.groupBy("block", "bundle").cogroup(right.groupBy("block", "bundle")).applyInArrow(run, ddl)
