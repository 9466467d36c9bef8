"""Multi-part CSV corpora whose labels live in the file names."""

from __future__ import annotations

import re
import warnings
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.expressions import label_from_file_name, part_number
from tidewatch.operators.ordering import running, running_count
from tidewatch.operators.sampling import class_counts, trim_to_cap


def discover_parts(spark: SparkSession, root: str) -> list[str]:
    """Every ``*.csv`` below ``root``, sorted by path; none is an error."""
    listing = (
        spark.read.format("text")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(root)
    )
    # The listing is percent-encoded; readers want plain paths.
    parts = sorted(unquote(path) for path in listing.inputFiles())
    if not parts:
        raise FileNotFoundError(f"no *.csv files found under {root}")
    return parts


def _reader(spark: SparkSession):
    return (
        spark.read.option("header", True)
        .option("positiveInf", "inf")
        .option("negativeInf", "-inf")
        .option("nanValue", "nan")
    )


#: Types a column can have, by rank: the wider of two numbers holds both.
EMPTY, INT, LONG, DOUBLE, BOOLEAN, TEXT = range(6)
TYPES = {
    EMPTY: T.StringType(), INT: T.IntegerType(), LONG: T.LongType(), DOUBLE: T.DoubleType(),
    BOOLEAN: T.BooleanType(), TEXT: T.StringType(),
}
# How a CSV part writes numbers.
WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
DECIMAL = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def _rank(text: Column) -> Column:
    """The narrowest type of one field."""
    word = F.lower(F.trim(text))
    number = F.when(text.rlike(WHOLE), F.when(F.abs(text.cast("long")) < 1 << 31, INT).otherwise(LONG)).when(
        text.rlike(DECIMAL) | word.isin("inf", "-inf", "nan"), DOUBLE
    )
    return F.when(text.isNull() | (word == ""), EMPTY).otherwise(
        F.coalesce(number, F.when(word.isin("true", "false"), BOOLEAN).otherwise(TEXT))
    )


def part_types(spark: SparkSession, parts: list[str]) -> DataFrame:
    """(part, column, place, type): the rank of the type of each column in each part, from its values.

    The column list is that of the first part, and a part with another header fails the job. Within a
    part a mix of text, numbers and truth values is text.
    """
    names = _reader(spark).csv(parts[0]).schema.names
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    frame = _reader(spark).schema(schema).option("enforceSchema", False).option("mode", "FAILFAST").csv(parts)
    ranks = [_rank(F.col(f"`{n}`")) for n in names]
    seen = []
    for place, (name, rank) in enumerate(zip(names, ranks, strict=True)):
        low = F.min(F.when(rank != EMPTY, rank))
        high = F.max(rank)
        mixed = (high >= BOOLEAN) & (low != high)
        seen.append(F.struct(
            F.lit(name).alias("column"), F.lit(place).alias("place"), F.when(mixed, TEXT).otherwise(high).alias("type")
        ))
    by_part = frame.groupBy(F.col("_metadata.file_path").alias("part")).agg(F.array(*seen).alias("seen"))
    return by_part.select("part", F.inline("seen"))


def infer_layout(spark: SparkSession, parts: str | list[str]) -> T.StructType:
    """Column names, and for each column the narrowest type that holds its values in every part.

    Whole numbers widen to larger ones and to decimals; a column that is empty everywhere is text. A
    column that is text or truth values in one part and numbers in another is an error.
    """
    parts = [parts] if isinstance(parts, str) else parts
    merged = part_types(spark, parts).where(F.col("type") != EMPTY).groupBy("place", "column").agg(
        F.min("type").alias("low"), F.max("type").alias("high"),
        F.min_by("part", "type").alias("one"), F.max_by("part", "type").alias("other"),
    )
    # One row for each column.
    found = {r["column"]: r for r in merged.collect()}
    fields = []
    for name in _reader(spark).csv(parts[0]).schema.names:
        row = found.get(name)
        if row is not None and row["high"] >= BOOLEAN and row["low"] != row["high"]:
            kinds = [TYPES[row[k]].simpleString() for k in ("low", "high")]
            raise ValueError(f"column {name!r} is {kinds[0]} in {row['one']} and {kinds[1]} in {row['other']}")
        fields.append(T.StructField(name, TYPES[row["high"] if row else EMPTY]))
    return T.StructType(fields)


def _decoded(path: Column) -> Column:
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def scan_parts(
    spark: SparkSession,
    root: str,
    schema: T.StructType | None = None,
    parts: list[str] | None = None,
    with_label: bool = True,
) -> DataFrame:
    """Read all parts as one table with ``source_file`` and ``label``.

    The layout is that of all parts together, or ``schema``. A part with another header, or a value
    that does not fit the column's type, fails the job: rows are never silently turned into nulls.
    """
    parts = parts if parts is not None else discover_parts(spark, root)
    schema = schema or infer_layout(spark, parts)
    frame = (
        _reader(spark)
        .schema(schema)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(parts)
    )
    below_root = re.escape(root.split("://")[-1].rstrip("/")) + "/(.*)$"
    source = F.regexp_extract(_decoded(F.col("_metadata.file_path")), below_root, 1)
    name = _decoded(F.col("_metadata.file_name"))
    columns = [F.col(f"`{c}`") for c in schema.names]
    columns += [
        source.alias("source_file"),
        part_number(name).alias("part_number"),
        F.col("_metadata.file_block_start").alias("block_start"),
    ]
    if with_label:
        columns.append(label_from_file_name(name).alias("label"))
    return frame.select(*columns)


def with_positions(frame: DataFrame) -> DataFrame:
    """Add ``pos``: dense over (label, part number, path, line), the pooled row order.

    Lines are numbered within their file split, and split counts are carried forward, so no task
    sees more than one split.
    """
    order = F.monotonically_increasing_id()
    chunk = [F.col(c) for c in ("label", "part_number", "source_file", "block_start")]
    return running(
        frame.withColumn("__line", order),
        [],
        [F.col("__line")],
        chunk,
        {"pos": running_count(inclusive=False)},
    ).drop("__line", "part_number", "block_start")


def surviving_parts(counts: DataFrame, per_class_cap: int) -> DataFrame:
    """Parts read under the cap: a part is read when the rows before it are below the cap.

    ``counts`` has (label, part_number, source_file, n_rows), one row per part.
    """
    if per_class_cap <= 0:
        raise ValueError(f"per_class_cap must be positive, got {per_class_cap}")
    earlier = (
        Window.partitionBy("label")
        .orderBy("part_number", "source_file")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("n_rows").over(earlier), F.lit(0))
    return counts.withColumn("rows_before", before).where(
        F.col("rows_before") < per_class_cap
    )


def capped_subsample(
    spark: SparkSession, root: str, target: int, per_class_cap: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """The class-capped pooled frame and its realised class counts.

    One counting pass over the parts picks those the cap reaches; only these are read again. The
    overshoot of the last part is trimmed by seeded draw, keeping row order.
    """
    if target <= 0:
        raise ValueError(f"target must be positive, got {target}")
    parts = discover_parts(spark, root)
    schema = infer_layout(spark, parts)
    counts = (
        scan_parts(spark, root, schema, parts)
        .groupBy("label", "part_number", "source_file")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    # One row per file: the file list is on the driver already.
    chosen = {r["source_file"] for r in surviving_parts(counts, per_class_cap).collect()}
    by_source = {_relative(p, root): p for p in parts}
    frame = with_positions(
        scan_parts(spark, root, schema, [by_source[s] for s in sorted(chosen)])
    )
    kept = trim_to_cap(frame, "label", "pos", per_class_cap, seed)
    realised = class_counts(kept, "label")
    total = realised.agg(F.sum("n_rows")).first()[0] or 0
    if not 0.5 * target <= total <= 1.5 * target:
        warnings.warn(
            f"the subsample has {total} rows, more than 50% away from the target {target}",
            stacklevel=2,
        )
    return kept, realised


def _relative(path: str, root: str) -> str:
    marker = root.split("://")[-1].rstrip("/") + "/"
    return path[path.index(marker) + len(marker):]
