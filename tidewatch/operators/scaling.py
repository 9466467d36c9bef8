"""Standardisation: pooled fit, per-client statistics and their combination."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expressions import all_finite, require_columns
from tidewatch.operators.ordering import bounded_table


def _feature_stats(features: Sequence[str]) -> list[Column]:
    """One struct per feature; Spark's central moments merge by the parallel formula.

    Merging leaves rounding noise on a constant feature, which a scaler would divide by, so a
    feature whose extremes agree gets its exact mean and no deviation.
    """
    stats = []
    for name in features:
        x = F.col(name).cast("double")
        constant = F.min(x) == F.max(x)
        stats.append(
            F.struct(
                F.lit(name).alias("feature"),
                F.count(name).alias("count"),
                F.when(constant, F.min(x)).otherwise(F.avg(x)).alias("mean"),
                F.when(constant, F.lit(0.0))
                .otherwise(F.var_pop(x) * F.count(name))
                .alias("m2"),
            )
        )
    return stats


def _long(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.inline("stats"))


def _finite_or_fail(df: DataFrame, features: Sequence[str]) -> Column:
    stats = F.array(*_feature_stats(features))
    return (
        F.when(F.count_if(~all_finite(features)) > 0, F.raise_error(F.lit(
            "features contain non-finite values; drop them before fitting")))
        .when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("cannot fit on zero rows")))
        .otherwise(stats)
        .alias("stats")
    )


def fit_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, count, mean, m2) over training rows; empty or non-finite input fails the job."""
    require_columns(df, features)
    return _long(df.agg(_finite_or_fail(df, features)), [])


def client_stats(df: DataFrame, client: str, features: Sequence[str]) -> DataFrame:
    """:func:`fit_scaler` within each client: (client, feature, count, mean, m2)."""
    require_columns(df, [client, *features])
    return _long(df.groupBy(client).agg(_finite_or_fail(df, features)), [client])


def combine_stats(parts: DataFrame) -> DataFrame:
    """Pool client statistics without their rows: means first, then squared deviations.

    Clients without rows are skipped; when none has any, that is an error. A feature that some client does not report fails the job.
    A feature that is one constant for all clients stays exactly that.
    """
    filled = parts.where(F.col("count") > 0)
    if filled.isEmpty():
        raise ValueError("none of the clients has rows to combine")
    weighted = filled.groupBy("feature").agg(
        F.sum("count").alias("n"),
        F.count(F.lit(1)).alias("reporting"),
        F.when(F.min("mean") == F.max("mean"), F.min("mean"))
        .otherwise(F.sum(F.col("count") * F.col("mean")) / F.sum("count"))
        .alias("center"),
    )
    most = weighted.agg(F.max("reporting")).scalar()
    between = F.col("count") * F.pow(F.col("mean") - F.col("center"), 2)
    uneven = F.raise_error(F.lit("clients disagree about the feature list"))
    return (
        filled.join(bounded_table(weighted), "feature")
        .groupBy("feature")
        .agg(
            F.first("n").alias("count"),
            F.first("center").alias("mean"),
            F.sum(F.col("m2") + between).alias("m2"),
            F.first("reporting").alias("reporting"),
        )
        .select(
            "feature",
            F.when(F.col("reporting") == most, F.col("count"))
            .otherwise(uneven.cast("long"))
            .alias("count"),
            "mean",
            "m2",
        )
    )


def scaler_std() -> Column:
    """Population deviation of a statistics row, 1 for a constant feature."""
    deviation = F.sqrt(F.col("m2") / F.col("count"))
    return F.when(deviation > 0, deviation).otherwise(F.lit(1.0))


def scaler_gap(federated: DataFrame, pooled: DataFrame) -> DataFrame:
    """Largest relative gap of combined against pooled means and deviations; one row."""
    left = federated.select("feature", F.col("mean").alias("fm"), scaler_std().alias("fs"))
    right = pooled.select("feature", F.col("mean").alias("pm"), scaler_std().alias("ps"))

    def relative(a: str, b: str) -> Column:
        floor = F.greatest(F.max(F.abs(F.col(b))), F.lit(1e-12))
        return F.max(F.abs(F.col(a) - F.col(b))) / floor

    return left.join(right, "feature").agg(
        F.greatest(relative("fm", "pm"), relative("fs", "ps")).alias("gap")
    )


@dataclass(frozen=True)
class Scaler:
    """A fitted scaler: two numbers per feature, applied as a plain projection."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @classmethod
    def from_table(cls, stats: DataFrame, features: Sequence[str]) -> Scaler:
        fitted = {
            r["feature"]: (r["mean"], r["std"])
            for r in stats.select("feature", "mean", scaler_std().alias("std")).collect()
        }
        missing = [f for f in features if f not in fitted]
        if missing or not features:
            raise ValueError(f"the scaler was not fitted on {missing or 'any feature'}")
        return cls(
            tuple(features),
            tuple(fitted[f][0] for f in features),
            tuple(fitted[f][1] for f in features),
        )

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> Scaler:
        return cls.from_table(fit_scaler(df, features), features)

    def scaled(self, feature: str) -> Column:
        at = self.features.index(feature)
        return (F.col(feature).cast("double") - self.means[at]) / self.deviations[at]

    def transform(self, df: DataFrame) -> DataFrame:
        require_columns(df, self.features)
        return df.withColumns({f: self.scaled(f) for f in self.features})


def class_weights(counts: DataFrame, n: str) -> DataFrame:
    """Add ``weight`` = total / (classes * count) over the declared classes, 0 for an absent one.

    ``counts`` has one row per declared class; negative or all-zero counts fail the job.
    """
    totals = counts.agg(
        F.sum(n).alias("total"), F.count(F.lit(1)).alias("classes"), F.min(n).alias("least")
    )
    total = totals.select("total").scalar()
    classes = totals.select("classes").scalar()
    least = totals.select("least").scalar()
    bad = F.raise_error(F.lit("class counts must be non-negative and not all zero"))
    weight = F.when(
        F.col(n) > 0, total.cast("double") / (classes * F.col(n))
    ).otherwise(F.lit(0.0))
    return counts.withColumn(
        "weight", F.when((least < 0) | (total <= 0), bad.cast("double")).otherwise(weight)
    )
