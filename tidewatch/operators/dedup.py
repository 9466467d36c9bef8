"""Exact duplicates: fingerprints, keep-first dedup, counts and the leakage gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.bloom import bloom_filter, may_contain
from tidewatch.operators.ordering import by_position, running_count
from tidewatch.session import cut_lineage

NULL_MARK = "∅"
#: Equal test rows beyond which a fingerprint is not joined by shuffle.
HOT_ROWS = 1 << 17


def record_hash(columns: Sequence[str]) -> Column:
    """64-bit fingerprint over the columns in order, as 16 hex digits."""
    return F.lower(F.lpad(F.hex(F.xxhash64(*columns)), 16, "0"))


def record_md5(columns: Sequence[str]) -> Column:
    """128-bit fingerprint other engines can recompute: md5 over the text of the columns.

    Each value is written with its length, so values cannot run into each other.
    """

    def field(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        sized = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        return F.coalesce(sized, F.lit(NULL_MARK))

    return F.md5(F.concat_ws("|", *[field(c) for c in columns]))


def keep_first(df: DataFrame, pos: str, subset: Sequence[str] | None = None) -> DataFrame:
    """The first row, by ``pos``, of every group of equal rows.

    Equality covers every column but ``pos`` unless ``subset`` is given. Copies are merged by a
    partial aggregate before the shuffle, so a group that holds a third of the rows arrives as
    one row per task.
    """
    rest = [c for c in df.columns if c != pos]
    keys = list(subset) if subset is not None else rest
    if set(keys) == set(rest):
        return df.groupBy(*keys).agg(F.min(pos).alias(pos)).select(*df.columns)
    carried = [c for c in rest if c not in keys]
    first = F.min_by(F.struct(*carried), F.col(pos)).alias("__row")
    merged = df.groupBy(*keys).agg(F.min(pos).alias(pos), first)
    return merged.select(*keys, pos, "__row.*").select(*df.columns)


def deduplicate(
    df: DataFrame, pos: str, subset: Sequence[str] | None = None, bits: int | None = None
) -> DataFrame:
    """:func:`keep_first`, then ``pos`` renumbered to a dense 0-based range in the same order."""
    kept = keep_first(df, pos, subset).withColumnRenamed(pos, "__old_pos")
    options = {} if bits is None else {"bits": bits}
    numbered = by_position(
        kept, [], "__old_pos", {pos: running_count(inclusive=False)}, **options
    )
    return numbered.select(*df.columns)


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, distinct rows and exact duplicates.

    Only fingerprints are shuffled, one per group of equal rows and task.
    """
    fingerprint = record_md5(columns or df.columns).alias("__print")
    groups = df.groupBy(fingerprint).agg(F.count(F.lit(1)).alias("__n"))
    return groups.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def _prints(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(record_md5(columns).alias("fingerprint"))


def _counted_prints(test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(fingerprint, n) of the test rows, counted before they are shuffled, and written once."""
    counted = _prints(test, columns).groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"))
    return cut_lineage(test.sparkSession, counted, "test-fingerprints")


def possible_leaks(train: DataFrame, columns: Sequence[str], counted: DataFrame) -> DataFrame:
    """The fingerprints of train rows that a Bloom filter of the test side does not rule out."""
    spark = train.sparkSession
    bloom = cut_lineage(spark, bloom_filter(counted, "fingerprint", counted.count()), "bloom-filter")
    return may_contain(_prints(train, columns), "fingerprint", bloom)


def leaked_fingerprints(
    train: DataFrame, test: DataFrame, columns: Sequence[str], counted: DataFrame | None = None
) -> DataFrame:
    """Fingerprints on both sides; the leakage gate wants none.

    Train rows that cannot be in the test side go before anything is shuffled. Both sides are
    distinct fingerprints then, so no hot record meets itself.
    """
    counted = _counted_prints(test, columns) if counted is None else counted
    return possible_leaks(train, columns, counted).distinct().join(
        counted.select("fingerprint"), "fingerprint", "left_semi"
    )


def leaked_rows(
    train: DataFrame, test: DataFrame, columns: Sequence[str], hot: int = HOT_ROWS
) -> DataFrame:
    """The test rows whose fingerprint also occurs in train.

    A fingerprint of more than ``hot`` test rows is looked up where its rows lie; there are at most
    rows / ``hot`` of them. The others are joined by shuffle, ``hot`` rows a key at most.
    """
    spark = test.sparkSession
    counted = _counted_prints(test, columns)
    offenders = cut_lineage(spark, leaked_fingerprints(train, test, columns, counted), "leaks")
    marked = test.withColumn("__print", record_md5(columns))
    offenders = offenders.select(F.col("fingerprint").alias("__print"), F.lit(True).alias("__leaked"))
    crowded = counted.where(F.col("n") > hot).select(F.col("fingerprint").alias("__print"), F.lit(True).alias("__hot"))
    crowded = crowded.join(offenders, "__print", "left")
    known = marked.join(F.broadcast(crowded), "__print", "left")
    of_hot = known.where("__leaked").select(*test.columns)
    rest = known.where("__hot IS NULL").join(offenders.select("__print"), "__print", "left_semi")
    return of_hot.unionByName(rest.select(*test.columns))
