"""Line dedup: lines found in many documents go; DataFrame functions only.

Each line becomes two 64-bit hashes of its key. The hashes are range-partitioned together with the
document and sorted by document and position, so the first occurrence in each document streams out
of one sorted pass, and a line that a third of all documents hold spreads over many ranges. The
number of documents of a key is a partial count. What comes back for a document is a keep bitmap,
run-length encoded, and no text.

Defined results: a text that is null or empty is one empty line. Lines whose key is shorter than
``min_chars`` always stay. Rows with the same id count as one document; rows without id count
together as one. Rows with the same id and text get the same bitmap. An empty table gives an empty
table. Extra columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import UPPER, WHITE, keyed, same_document
from tidewatch.session import cut_lineage


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WHITE)), UPPER, UPPER.lower())


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line: document, position, number of lines, two hashes, and if it can be dropped.

    A line that always stays gets hashes of its place instead, so that such lines don't meet.
    """
    lines = keyed(docs).select("doc_id", "text_key", split_lines(F.col("text")).alias("lines"))
    lines = lines.select(
        "doc_id", "text_key", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line")
    ).withColumn("key", line_key(F.col("line")))
    counts = F.char_length("key") >= min_chars
    place = [F.col("doc_id"), F.col("text_key"), F.col("pos")]
    return lines.select(
        "doc_id",
        "text_key",
        "n_lines",
        "pos",
        counts.alias("counts"),
        F.when(counts, F.xxhash64("key")).otherwise(F.xxhash64(*place)).alias("h1"),
        F.when(counts, F.xxhash64(F.lit(7), "key")).otherwise(F.xxhash64(F.lit(9), *place)).alias("h2"),
    )


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys of at least ``min_docs`` documents: hashes, number of documents, first occurrence."""
    firsts = (
        lines.where("counts")
        .select("h1", "h2", "doc_id", "pos")
        .repartitionByRange("h1", "h2", "doc_id")
        .sortWithinPartitions("h1", "h2", "doc_id", "pos")
        .groupBy("h1", "h2", "doc_id")
        .agg(F.min("pos").alias("pos"))
    )
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"), F.col("pos"))
    return (
        firsts.groupBy("h1", "h2")
        .agg(F.count("*").alias("n_docs"), F.min(order).alias("first"))
        .where(F.col("n_docs") >= min_docs)
    )


def line_bitmaps(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False
) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep_runs) of each document.

    ``keep_runs`` is the keep bitmap as runs of kept lines: (start, length), start from 0. With
    ``keep_first`` the first occurrence of each repeated line stays, in order of document and
    position.
    """
    spark = docs.sparkSession
    lines = cut_lineage(spark, line_table(docs, min_chars), "line-hashes")
    repeated = cut_lineage(spark, repeated_lines(lines, min_docs), "repeated-lines")
    dropped = F.col("counts") & F.col("n_docs").isNotNull()
    if keep_first:
        dropped = dropped & ~(
            F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.pos") == F.col("pos"))
        )
    per_document = (
        lines.join(repeated, ["h1", "h2"], "left")
        .groupBy("doc_id", "text_key")
        .agg(
            F.max("n_lines").alias("n_lines"),
            F.array_sort(F.collect_set(F.when(dropped, F.col("pos")))).alias("gone"),
        )
    )
    edges = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.col("n_lines")))
    runs = F.transform(
        F.sequence(F.lit(1), F.size("edges") - 1),
        lambda i: F.struct(
            (F.get("edges", i - 1) + 1).alias("start"),
            (F.get("edges", i) - F.get("edges", i - 1) - 1).alias("length"),
        ),
    )
    return per_document.withColumn("edges", edges).select(
        "doc_id",
        "text_key",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.filter(runs, lambda r: r["length"] > 0).alias("keep_runs"),
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each row of ``docs`` with ``n_lines``, ``n_dropped`` and ``kept_text``; of its own columns
    those named, or id and text."""
    own = columns or ["doc_id", "text"]
    rows = docs.select(
        F.struct(*[F.col(c) for c in own]).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )
    lines = split_lines(F.col("text"))
    kept = F.array_join(
        F.flatten(
            F.transform("keep_runs", lambda r: F.slice("lines", r["start"] + 1, r["length"]))
        ),
        "\n",
    )
    return (
        rows.alias("d")
        .join(bitmaps.alias("b"), same_document("d", "b"))
        .select("row", "n_lines", "n_dropped", "keep_runs", "d.text", lines.alias("lines"))
        .select(
            "row.*",
            "n_lines",
            "n_dropped",
            F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept).alias("kept_text"),
        )
    )
