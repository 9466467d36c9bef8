"""What the operators share: document keys, folds, Arrow helpers and byte packs of many texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewatch.session import cut_lineage

#: A word, as the contracts of the queries have it.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key`` and ``text`` (null: empty) of each row; other columns go.

    Rows with the same id and text are one document and get the same result. The pair is the key
    of every join, so a repeated or missing id neither multiplies nor loses rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )


def same_document(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.text_key") == F.col(f"{right}.text_key")
    )


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; an id that is missing is in fold 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


#: Bytes of text of each class that a fit may see, about.
CLASS_BYTES = 64 << 20


def drawn(rows: DataFrame, share: Column | float, seed: int) -> DataFrame:
    """Those of ``rows`` (doc_id, text_key) that a hash of both draws; the same in every run."""
    hashed = F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1).cast("long")), F.col("text_key"))
    return rows.where(F.pmod(hashed, F.lit(1 << 40)) / float(1 << 40) < share)


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int, folds: int, held_out: int,
                    class_bytes: int = CLASS_BYTES):
    """Labelled documents outside the held-out fold: about ``per_class`` and ``class_bytes`` of each class.

    Returns (doc_id, text_key, label) of the sample, and {label: number of documents before
    sampling}. Rows with equal id and text are one document. An id labelled twice counts as 1 if any
    of its labels is 1; rows without id or label are left out.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .where(fold("doc_id", folds) != held_out)
    )
    sized = keyed(docs).select("doc_id", "text_key", F.octet_length("text").cast("long").alias("bytes"))
    found = cut_lineage(docs.sparkSession, sized.join(known, "doc_id").distinct(), "labelled-documents")
    # Two rows at most.
    totals = found.groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect()
    share = F.lit(0.0)
    for row in totals:
        rate = min(per_class / row["n"], class_bytes / max(row["bytes"], 1))
        share = F.when(F.col("label") == row["label"], F.lit(rate)).otherwise(share)
    sample = drawn(found, share, 17).select("doc_id", "text_key", "label")
    return sample, {row["label"]: row["n"] for row in totals}


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``sample`` (doc_id, text_key, ...) with each document's ``text``; a sample has a bounded size."""
    picked = keyed(docs).alias("d").join(F.broadcast(sample).alias("s"), same_document("d", "s"))
    named = [F.col(f"s.{c}") for c in sample.columns]
    return picked.select(*named, "d.text").dropDuplicates(["doc_id", "text_key"])


#: Rows and bytes of text that become Python objects at once.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20


def text_slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of ``batch``, few enough for their texts to be held; a longer text is alone."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, own in enumerate(sizes.tolist()):
        if i > begin and (i - begin == SLICE_ROWS or size + own > SLICE_BYTES):
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += own
    if batch.num_rows:
        yield batch.slice(begin)


def with_scores(docs: DataFrame, columns: tuple[str, ...], score: Callable[[list], dict[str, list]], added: str) -> DataFrame:
    """Each row's ``columns``, and the columns ``added`` (DDL) that ``score`` finds from texts.

    The row's own columns stay Arrow arrays; only the texts of a few rows become Python objects.
    """
    spark = docs.sparkSession
    own = docs.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(columns)], F.col("text").alias("__text"))
    kept = own.drop("__text")
    new = StructType.fromDDL(added).fields
    out = StructType([*kept.schema.fields, *[StructField(f"__{f.name}", f.dataType) for f in new]])
    arrow = to_arrow(spark, out)
    # A text that is among the columns comes once.
    text = f"__{columns.index('text')}" if "text" in columns else "__text"
    own = own if text == "__text" else kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, text):
                found = score(part[text].to_pylist())
                arrays = [part[f.name] if f.name in part.schema.names else pa.array(found[f.name[2:]], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return own.mapInArrow(run, out).toDF(*columns, *[f.name for f in new])


def map_batches(df: DataFrame, rows: Callable[[dict], dict], schema: str) -> DataFrame:
    """Apply a function of column lists to each Arrow batch; ``schema`` names what it returns."""
    types = to_arrow(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = rows(batch.to_pydict())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in types], schema=types
            )

    return df.mapInArrow(run, schema)


def to_arrow(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def packs(texts: list[bytes], overlap: int, limit: int = 1 << 20) -> Iterator[tuple]:
    """Texts laid end to end, at most about ``limit`` bytes at a time.

    Yields (bytes, starts, owners): piece i begins at ``starts[i]`` and belongs to text
    ``owners[i]``. A longer text comes in pieces of which each repeats the last ``overlap`` bytes
    of the one before, so that no window of ``overlap + 1`` bytes is lost. A zero byte follows
    each piece.
    """
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0
    for owner, text in enumerate(texts):
        for at in range(0, max(len(text) - overlap, 1), limit):
            piece = text[at : at + limit + overlap]
            if size and size + len(piece) > limit:
                yield _laid(parts, owners)
                parts, owners, size = [], [], 0
            parts.append(piece)
            owners.append(owner)
            size += len(piece) + 1
    if parts:
        yield _laid(parts, owners)


def _laid(parts: list[bytes], owners: list[int]) -> tuple:
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    data = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    return data, starts, np.array(owners, np.int64)
