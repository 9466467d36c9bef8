"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates lie in blocks. In a block each component (term) has a posting list: the rows where it
is not 0, and the values there. A query is the sparse list of its own components; for each of them
its weight times the postings is scattered into a dense array of scores, one for each row of the
block. The k best of a block are selected from that array, and the blocks' selections are merged.

Components become floor(256 * x). Scores are inner products in 64-bit integers, which wrap like
Spark's long; components beyond the range of a long are held at its end.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do
rows without id. Of repeated ids one row takes part (see ``usable_vectors``). Vectors of different
lengths meet on the components both have; an empty or zero vector scores 0 with all. Ties go to
the smaller id. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.blocks import as_blocks, dealt, dense, each_pair, usable_vectors
from tidewatch.session import cut_lineage

ROWS, QUERIES = 8192, 1024
#: Queries whose score arrays are held at once.
AT_ONCE = 64


def integers(vectors: list[list[float]]) -> np.ndarray:
    scaled = np.floor(256.0 * dense(vectors))
    # The largest double below 2^63; a double above it does not fit a long.
    held = np.clip(scaled, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    return np.where(scaled >= 2.0**63, np.int64(2**63 - 1), held)


def posting_lists(matrix: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    lists = []
    for column in matrix.T:
        rows = np.flatnonzero(column)
        lists.append((rows, column[rows]))
    return lists


def accumulate(queries: np.ndarray, lists: list, n: int) -> np.ndarray:
    """Scores of each query with all ``n`` rows."""
    scores = np.zeros((len(queries), n), np.int64)
    with np.errstate(over="ignore"):
        for term in range(min(queries.shape[1], len(lists))):
            rows, values = lists[term]
            own = np.flatnonzero(queries[:, term])
            added = queries[own, term, None] * values[None, :]
            if len(rows) == n and len(own) == len(queries):
                scores += added
            else:
                scores[own[:, None], rows[None, :]] += added
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def top_k(vectors: DataFrame, is_query, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` holds, against all others."""
    spark = vectors.sparkSession
    usable = cut_lineage(spark, usable_vectors(vectors), "vectors")

    def block(rows: pa.Table):
        return [(rows["vec_id"].to_numpy(), integers(rows["vector"].to_pylist()))]

    def search(rows, asked):
        ids, matrix = rows
        lists = posting_lists(matrix)
        out = {"query_id": [], "vec_id": [], "score": []}
        for at in range(0, len(asked[0]), AT_ONCE):
            own = asked[0][at : at + AT_ONCE]
            for query, scores in zip(own, accumulate(asked[1][at : at + AT_ONCE], lists, len(ids)), strict=True):
                others = np.flatnonzero(ids != query)
                places = others[best(scores[others], ids[others], k)]
                out["query_id"] += [int(query)] * len(places)
                out["vec_id"] += ids[places].tolist()
                out["score"] += scores[places].tolist()
        return out

    left, n_left = dealt(usable, ROWS)
    right, n_right = dealt(usable.where(is_query), QUERIES)
    found = each_pair(
        as_blocks(left, block), n_left, as_blocks(right, block), n_right, search,
        pa.schema({"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()}),
        "query_id long, vec_id long, score long",
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
