"""How much a feature tells about the label: binned and nearest-neighbour mutual information, and
forest importance."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expressions import finite_rows
from tidewatch.operators.ordering import CHUNK_BITS, bounded_table, by_position, in_order, running_sum
from tidewatch.operators.profile import assemble
from tidewatch.operators.sampling import class_counts
from tidewatch.operators.scaling import class_weights
from tidewatch.session import cut_lineage


def mutual_information(binned: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, mi) in nats between discrete columns and the label, to twelve digits.

    Beyond those the order of summation shows, and twins must tie exactly to be told by name.

    One contingency table serves all features; the row counts are merged before the shuffle.
    """
    cells = (
        binned.select(
            label,
            F.explode(
                F.array(
                    *[
                        F.struct(
                            F.lit(f).alias("feature"), F.col(f).cast("string").alias("bin")
                        )
                        for f in features
                    ]
                )
            ).alias("cell"),
        )
        .groupBy("cell.feature", "cell.bin", label)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("n_bin"))
    by_label = cells.groupBy("feature", label).agg(F.sum("n").alias("n_label"))
    total = binned.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.col("n") / total
    gain = share * F.log(F.col("n") * total / (F.col("n_bin") * F.col("n_label")))
    return (
        cells.join(by_bin, ["feature", "bin"])
        .join(by_label, ["feature", label])
        .groupBy("feature")
        .agg(F.round(F.sum(gain), 12).alias("mi"))
    )


def quantile_bins(df: DataFrame, features: Sequence[str], bins: int = 32) -> DataFrame:
    """Replace each feature by the number of its quantile bin."""
    shares = [i / bins for i in range(1, bins)]
    edges = df.agg(
        *[F.percentile_approx(f, shares, 10_000).alias(f) for f in features]
    ).first()

    def bin_of(feature: str) -> Column:
        steps = F.array(*[F.lit(float(e)) for e in sorted(set(edges[feature]))])
        return F.size(F.filter(steps, lambda edge: edge < F.col(feature)))

    return df.withColumns({f: bin_of(f) for f in features})


def digamma(n: Column) -> Column:
    """The digamma function of a positive whole number, to about fifteen digits."""
    x = n.cast("double")
    z = x + 10
    steps = sum((1 / (x + i) for i in range(1, 10)), 1 / x)
    square = z * z
    # The first terms of the asymptotic series.
    series = 1 / (12 * square) - 1 / (120 * F.pow(square, 2)) + 1 / (252 * F.pow(square, 3))
    series = series - 1 / (240 * F.pow(square, 4)) + 1 / (132 * F.pow(square, 5))
    return F.log(z) - 1 / (2 * z) - series - steps


def _images(x: np.ndarray) -> np.ndarray:
    bits = x.view(np.int64)
    return np.where(bits < 0, np.int64(-(2**63)) - bits, bits)


def _doubles(images: np.ndarray) -> np.ndarray:
    return np.where(images < 0, np.int64(-(2**63)) - images, images).view(np.float64)


def nearer_than(x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, past): the doubles v with ``abs(v - x) < reach`` are those from ``first`` up to, but
    not including, ``past``; where ``reach`` is 0, x alone.

    Found by bisection over all doubles, as ``x - reach`` may round across a neighbour.
    """
    x, reach = x + 0.0, np.maximum(reach, 5e-324)
    own, end = _images(x), _images(np.array([np.inf]))[0]

    def edge(inside: np.ndarray, outside: np.ndarray) -> np.ndarray:
        for _ in range(64):
            # Halves are added apart, so that the sum stays a long.
            middle = inside // 2 + outside // 2 + ((inside & 1) + (outside & 1)) // 2
            near = np.abs(_doubles(middle) - x) < reach
            inside, outside = np.where(near, middle, inside), np.where(near, outside, middle)
        return inside

    with np.errstate(over="ignore", invalid="ignore"):
        low, high = edge(own, np.full_like(own, -end)), edge(own, np.full_like(own, end))
    return _doubles(low), _doubles(high + 1)


def reach_of_neighbours(x: np.ndarray, copies: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of sorted distinct values, the distance to the ``wanted``-th nearest other point.

    ``copies`` points have each value; a point's own copies are at distance 0.
    """
    n, most = len(x), int(wanted.max(initial=0))
    offsets = np.arange(-most, most + 1)
    at = np.arange(n)[:, None] + offsets
    outside = (at < 0) | (at >= n)
    at = np.clip(at, 0, n - 1)
    away = np.where(outside, np.inf, np.abs(x[at] - x[:, None]))
    points = np.where(outside, 0, copies[at] - (offsets == 0))
    order = np.argsort(away, axis=1, kind="stable")
    reached = np.cumsum(np.take_along_axis(points, order, axis=1), axis=1) >= wanted[:, None]
    return np.take_along_axis(away, order, axis=1)[np.arange(n), reached.argmax(axis=1)]


REACHES = "feature string, at long, value double, copies long, k int, n_label long, first double, past double"


def neighbour_reaches(points: DataFrame, neighbours: int, bits: int) -> DataFrame:
    """Each of ``points`` (feature, label, value, copies, n_label) with the interval that is nearer
    than its k-th neighbour of the same label.

    Points are sorted by feature, label and value and cut into chunks of that order; a chunk also
    sees the ``neighbours`` points on either side of it.
    """
    runs = in_order(points, F.col("feature"), F.col("label"), F.col("value"))
    first = F.greatest(F.shiftright(F.col("at") - neighbours, bits), F.lit(0).cast("long"))
    near = F.sequence(first, F.shiftright(F.col("at") + neighbours, bits))
    halo = runs.select("*", F.shiftright("at", bits).alias("own"), F.explode(near).alias("chunk"))
    schema = pa.schema([
        ("feature", pa.string()), ("at", pa.int64()), ("value", pa.float64()), ("copies", pa.int64()),
        ("k", pa.int32()), ("n_label", pa.int64()), ("first", pa.float64()), ("past", pa.float64()),
    ])

    def measure(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        x, copies = rows["value"].to_numpy(), rows["copies"].to_numpy()
        n_label = rows["n_label"].to_numpy()
        wanted = np.minimum(neighbours, n_label - 1)
        # Runs of one feature and label.
        named = rows.select(["feature", "label"]).to_pandas()
        begins = np.flatnonzero((named != named.shift()).any(axis=1).to_numpy())
        reach = np.zeros(len(x))
        for low, high in zip(begins, [*begins[1:], len(x)], strict=True):
            run = slice(low, high)
            reach[run] = reach_of_neighbours(x[run], copies[run], wanted[run])
        own = np.flatnonzero(rows["own"].to_numpy() == key[0].as_py())
        first, past = nearer_than(x[own], reach[own])
        kept = rows.take(pa.array(own))
        return pa.Table.from_arrays(
            [kept["feature"], kept["at"], kept["value"], kept["copies"], pa.array(wanted[own].astype(np.int32)),
             kept["n_label"], pa.array(first), pa.array(past)],
            schema=schema,
        )

    return halo.groupBy("chunk").applyInArrow(measure, REACHES)


def mutual_information_knn(
    df: DataFrame, features: Sequence[str], label: str, neighbours: int = 3, bits: int = CHUNK_BITS
) -> DataFrame:
    """(feature, mi) in nats between continuous features and the label, by nearest neighbours.

    Along each feature, a point's k-th nearest neighbour of its own label sets a distance, and the
    points of any label that are nearer are counted. With N points, N_c of the label and m counted
    (the point itself included), the estimate is psi(N) + mean(psi(k) - psi(N_c) - psi(m)), at
    least 0. k is ``neighbours``, or N_c - 1 of smaller labels; labels of one point take no part. At
    distance 0 the equal points are counted, so ties need no random jitter. To twelve digits.

    Rows with a null label or a feature that is not finite take no part. Equal points are merged
    before they move. Both the neighbours and the counts come from sorted runs that are cut at any
    place, so no task holds a feature or a label.
    """
    spark = df.sparkSession
    usable = finite_rows(df, features).where(F.col(label).isNotNull())
    cells = F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), (F.col(f).cast("double") + 0.0).alias("value")) for f in features
    ]))
    points = usable.select(F.col(label).cast("string").alias("label"), cells)
    points = points.groupBy("feature", "label", "value").agg(F.count(F.lit(1)).alias("copies"))
    points = cut_lineage(spark, points, "distinct-points")
    sizes = points.where(F.col("feature") == features[0]).groupBy("label").agg(F.sum("copies").alias("n_label"))
    sizes = bounded_table(sizes.where("n_label > 1"))
    reaches = cut_lineage(spark, neighbour_reaches(points.join(sizes, "label"), neighbours, bits), "reaches")
    # Both ends of an interval ask how many points lie below; a question stands before equal points.
    none = F.lit(None).cast("long")
    data = reaches.select("feature", F.col("value").alias("key"), F.lit(1).alias("kind"), "copies", none.alias("id"), F.lit(0).alias("side"))
    asked = reaches.select("feature", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("copies"), F.col("at").alias("id"), F.inline(F.array(
        F.struct(F.col("first").alias("key"), F.lit(-1).alias("side")), F.struct(F.col("past").alias("key"), F.lit(1).alias("side")),
    )))
    events = in_order(data.unionByName(asked), F.col("feature"), F.col("key"), F.col("kind"))
    below = by_position(events, ["feature"], "at", {"below": running_sum(F.col("copies"), inclusive=False)}, bits)
    counted = below.where("kind = 0").groupBy("id").agg(F.sum(F.col("below") * F.col("side")).alias("m"))
    each = reaches.join(counted, reaches["at"] == counted["id"])
    gain = F.col("copies") * (digamma(F.col("k")) - digamma(F.col("n_label")) - digamma(F.col("m")))
    found = each.groupBy("feature").agg(F.sum("copies").alias("n"), F.sum(gain).alias("gain"))
    estimate = digamma(F.col("n")) + F.col("gain") / F.col("n")
    return found.select("feature", F.round(F.greatest(estimate, F.lit(0.0)), 12).alias("mi"))


def forest_importance(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    trees: int = 200,
    depth: int = 5,
    seed: int = 0,
) -> DataFrame:
    """(feature, importance): impurity importance of a class-balanced random forest."""
    weights = bounded_table(class_weights(class_counts(df, label), "n_rows"))
    weighted = df.select(label, *features).join(weights.select(label, "weight"), label)
    indexed = StringIndexer(inputCol=label, outputCol="__y").fit(weighted).transform(weighted)
    model = RandomForestClassifier(
        featuresCol="__x",
        labelCol="__y",
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        seed=seed,
    ).fit(assemble(indexed, features, "__x"))
    scores = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame(
        [(f, float(scores[i])) for i, f in enumerate(features)],
        "feature string, importance double",
    )
