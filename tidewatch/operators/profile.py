"""Corpus profile: counts, extremes, class balance and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.expressions import INFINITY, finite_rows, numeric_columns
from tidewatch.operators.comoments import correlations
from tidewatch.operators.ordering import CHUNK_BITS, by_position, in_order, running_sum
from tidewatch.session import cut_lineage


def _fractional(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))


def _double(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a fractional column."""
    column = F.col(f"`{name}`")
    return column.isNull() | F.isnan(column) if _fractional(df, name) else column.isNull()


def _present(df: DataFrame, name: str) -> Column:
    return F.when(~missing(df, name), F.col(f"`{name}`"))


def profile(df: DataFrame) -> DataFrame:
    """(column, type, n_rows, null_count, infinite_count) in one aggregate over the table.

    ``infinite_count`` is null for columns that are not numeric.
    """
    numeric = set(numeric_columns(df))
    stats = []
    for field in df.schema.fields:
        name = field.name
        infinite = (
            F.count_if(F.abs(F.col(f"`{name}`").cast("double")) == INFINITY)
            if name in numeric
            else F.lit(None).cast("long")
        )
        stats.append(
            F.struct(
                F.lit(name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("type"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(missing(df, name)).alias("null_count"),
                infinite.alias("infinite_count"),
            )
        )
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def _extremes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, constant, all_missing) from one aggregate of minima and maxima."""
    stats = [
        F.struct(
            F.lit(name).alias("column"),
            F.coalesce(
                F.min(_present(df, name)) == F.max(_present(df, name)), F.lit(False)
            ).alias("constant"),
            (F.count(_present(df, name)) == 0).alias("all_missing"),
        )
        for name in columns
    ]
    return df.agg(F.array(*stats).alias("stats")).select(F.inline("stats"))


def zero_variance(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct value; an all-null column is not listed."""
    return _extremes(df, df.columns).where("constant").select("column")


def stage1_columns(df: DataFrame, bookkeeping: Sequence[str]) -> DataFrame:
    """(column, kept) of the rule-based elimination.

    Dropped are bookkeeping columns, columns that are not numeric, and numeric columns with at
    most one distinct non-null value.
    """
    numeric = [c for c in numeric_columns(df) if c not in set(bookkeeping)]
    rejected = [c for c in df.columns if c not in numeric]
    kept = _extremes(df, numeric).select(
        "column", (~F.col("constant") & ~F.col("all_missing")).alias("kept")
    )
    if not rejected:
        return kept
    names = F.explode(F.array(*[F.lit(c) for c in rejected]))
    return kept.unionByName(
        df.sparkSession.range(1).select(names.alias("column"), F.lit(False).alias("kept"))
    )


def imbalance_ratio(df: DataFrame, label: str) -> DataFrame:
    """Largest over smallest class count; NaN without any label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.coalesce(F.max("n") / F.min("n"), F.lit(float("nan"))).alias("imbalance_ratio")
    )


def pearson_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for all pairs, over rows finite in every column.

    An undefined coefficient is 0 and the diagonal is 1.
    """
    columns = list(columns)
    values = F.array(*[_double(c) for c in columns])
    pairs = correlations(finite_rows(df, columns), values, columns, far=True)
    return df.sparkSession.createDataFrame(pairs, "a string, b string, r double")


def average_ranks(counted: DataFrame, bits: int = CHUNK_BITS) -> DataFrame:
    """(feature, value, rank) from (feature, value, n): ties share the mean of their ranks."""
    placed = by_position(
        in_order(counted, F.col("feature"), F.col("value")),
        ["feature"],
        "at",
        {"before": running_sum(F.col("n"), inclusive=False)},
        bits,
    )
    return placed.select("feature", "value", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman_matrix(df: DataFrame, columns: Sequence[str], bits: int = CHUNK_BITS) -> DataFrame:
    """(a, b, r): absolute rank correlation with average ranks for ties, over finite rows.

    All columns go through the same few shuffles: the (column, value) pairs are counted, sorted and
    ranked together, the ranks return to the pairs, and the pairs to their rows. Values are counted
    before they move, so one that fills a third of a column is a row for each task.
    """
    columns = list(columns)
    spark = df.sparkSession
    usable = finite_rows(df, columns).select(
        F.monotonically_increasing_id().alias("row"), F.array(*[_double(c) for c in columns]).alias("v")
    )
    usable = cut_lineage(spark, usable, "numbered-rows")
    cells = usable.select("row", F.posexplode("v").alias("feature", "value"))
    counted = cells.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranks = average_ranks(counted, bits)
    # As many cells a row as there are columns.
    own = F.array_sort(F.collect_list(F.struct("feature", "rank")))
    ranked = cells.join(ranks, ["feature", "value"]).groupBy("row").agg(own.alias("ranks"))
    pairs = correlations(ranked, F.transform("ranks", lambda r: r["rank"]), columns)
    return spark.createDataFrame([(a, b, abs(r)) for a, b, r in pairs], "a string, b string, r double")


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)
