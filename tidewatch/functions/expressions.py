"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")

# How a part's file name carries its label and number.
PART_SUFFIX = r"(?i)(?:\.pcap)?\.csv$"
PART_NUMBER = r"(?i)(\d+)(?:\.pcap)?\.csv$"


def is_finite(column: Column | str) -> Column:
    """Neither null, NaN nor infinite."""
    value = (F.col(column) if isinstance(column, str) else column).cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != INFINITY)


def all_finite(columns: Sequence[str]) -> Column:
    condition = F.lit(True)
    for name in columns:
        condition = condition & is_finite(name)
    return condition


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` are all finite; nothing is imputed."""
    return df.where(all_finite(columns))


def finite_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: how many rows the finite filter keeps and excludes."""
    return df.agg(
        F.count_if(all_finite(columns)).alias("kept"),
        F.count_if(~all_finite(columns)).alias("excluded"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def project_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly the fitted feature columns, in their order."""
    require_columns(df, columns)
    return df.select(*columns)


def label_from_file_name(name: Column) -> Column:
    """The label a part's file name carries: suffix, part number and separators removed."""
    stem = F.regexp_replace(name, PART_SUFFIX, "")
    return F.regexp_replace(F.regexp_replace(stem, r"\d+$", ""), r"[-_]+$", "")


def part_number(name: Column) -> Column:
    """The part number at the end of a file name, 0 without one."""
    digits = F.regexp_extract(name, PART_NUMBER, 1)
    return F.coalesce(F.nullif(digits, F.lit("")).cast("long"), F.lit(0))


def is_malicious(class_index: Column) -> Column:
    return class_index > 0


def attack_score(probabilities: Column) -> Column:
    """1 - P(benign)."""
    return 1.0 - F.element_at(probabilities, 1)


def near_ceiling_note(accuracy: Column, threshold: float) -> Column:
    """A caution beside an accuracy at or above ``threshold``, null below it."""
    text = F.format_string(
        "accuracy %.4f is at or above %.4f: read macro-F1 and the false-positive rate instead",
        F.bround(accuracy, 4),
        F.lit(threshold),
    )
    return (
        F.when(
            (accuracy < 0) | (accuracy > 1) | accuracy.isNull() | F.isnan(accuracy),
            F.raise_error(F.lit("accuracy must be a fraction in [0, 1]")),
        )
        .when(accuracy >= threshold, text)
    )


def alert_reason(device: Column, counter: Column) -> Column:
    """The reason text of an alert (fixed format)."""
    return F.format_string(
        "classifier verdict: malicious (device=%s, counter=%s)",
        device.cast("string"),
        counter.cast("string"),
    )
