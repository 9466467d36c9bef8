"""Metrics, reports, selection and parameter aggregation: the hand-computed cases."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewatch.functions import expressions as X
from tidewatch.operators import metrics as M
from tidewatch.operators import parameters as A
from tidewatch.operators import relevance as V
from tidewatch.operators import report as R
from tidewatch.operators import selection as L


def judged(spark, truth, prediction):
    return spark.createDataFrame(list(zip(truth, prediction)), "t int, p int")


def macro(spark, truth, prediction, n):
    return M.macro_metrics(M.confusion(judged(spark, truth, prediction), "t", "p", n)).first()


def test_majority_verdict_is_not_flattered(spark):
    m = macro(spark, [0] * 96 + [1, 1, 2, 2], [0] * 100, 3)
    assert m["accuracy"] == 0.96 and m["mcc"] == 0.0
    assert m["balanced_accuracy"] == pytest.approx(1 / 3) and m["macro_f1"] < 0.35


def test_absent_class_counts_in_macro_only(spark):
    m = macro(spark, [0, 0, 1, 1], [0, 0, 1, 1], 3)
    assert m["macro_f1"] == pytest.approx(2 / 3)
    assert m["balanced_accuracy"] == 1.0 and m["mcc"] == pytest.approx(1.0)


def test_confusion_keeps_zeros_and_rejects_strangers(spark):
    cells = M.confusion(judged(spark, [0, 1], [0, 0]), "t", "p", 3)
    assert cells.count() == 9 and cells.agg(F.sum("n")).first()[0] == 2
    with pytest.raises(PySparkException, match="outside"):
        M.confusion(judged(spark, [0], [3]), "t", "p", 3).collect()


def scored(spark, truth, score):
    return spark.createDataFrame(
        list(zip(truth, map(float, score))), "t int, s double"
    )


def test_binary_metrics(spark):
    b = M.binary_metrics(
        scored(spark, [0, 0, 0, 0, 1, 1], [0.9, 0.8, 0.1, 0.2, 0.95, 0.7]), "t", "s"
    ).first()
    assert tuple(b) == (0.5, 1.0, 0.5)
    none = M.binary_metrics(scored(spark, [1, 1], [0.1, 0.2]), "t", "s").first()
    assert tuple(none) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("rows_per_chunk", [5, 1 << 18])
def test_average_precision_with_ties(spark, rows_per_chunk):
    rng = random.Random(3)
    truth = [rng.randrange(2) for _ in range(200)]
    score = [round(rng.random(), 1) if rng.random() < 0.7 else rng.random() for _ in truth]
    expected, tp, seen, before = 0.0, 0, 0, 0.0
    for s in sorted(set(score), reverse=True):
        tp += sum(t for t, v in zip(truth, score) if v == s)
        seen += score.count(s)
        recall = tp / sum(truth)
        expected += (recall - before) * tp / seen
        before = recall
    got = M.average_precision(scored(spark, truth, score), "t", "s", rows_per_chunk).first()[0]
    assert got == pytest.approx(expected, abs=1e-12)


def test_average_precision_needs_both_classes(spark):
    assert math.isnan(M.average_precision(scored(spark, [1, 1], [0.2, 0.4]), "t", "s").first()[0])


def test_fpr_without_benign_rows_is_nan(spark):
    matrix = M.confusion(judged(spark, [1, 2], [1, 0]), "t", "p", 3)
    assert math.isnan(M.fpr_from_confusion(matrix).first()[0])
    matrix = M.confusion(judged(spark, [0, 0, 0, 0], [0, 1, 0, 2]), "t", "p", 3)
    assert M.fpr_from_confusion(matrix).first()[0] == 0.5


def test_ceiling_note(spark):
    df = spark.createDataFrame([(0.979,), (0.98,), (1.0,)], "a double")
    notes = [r[0] for r in df.select(X.near_ceiling_note(F.col("a"), 0.98)).collect()]
    assert notes[0] is None and notes[1].startswith("accuracy 0.9800") and notes[2]
    with pytest.raises(PySparkException):
        spark.range(1).select(X.near_ceiling_note(F.lit(1.5), 0.98)).collect()


def test_seed_summary_skips_nan(spark):
    df = spark.createDataFrame(
        [("m", 0.5), ("m", 0.7), ("m", float("nan")), ("n", float("nan"))], "k string, v double"
    )
    got = {r["k"]: r for r in R.seed_summary(df, ["k"], "v", "f1").collect()}
    assert got["m"]["summary"] == "f1: 0.6000 +/- 0.1000 (n=3)"
    assert math.isnan(got["n"]["mean"])


def test_bracket_and_ablation(spark):
    rows = [("c", "local_only", 0, 0.4), ("c", "federated", 0, 0.7), ("c", "centralized", 0, 0.8),
            ("d", "local_only", 0, 0.9), ("d", "federated", 0, 0.7), ("d", "centralized", 0, 0.8)]
    df = spark.createDataFrame(rows, "config string, model string, seed int, f double")
    got = {r["config"]: r for r in R.bracket(df, ["config"], "f").collect()}
    assert got["c"]["inside"] and got["c"]["recovered"] == pytest.approx(0.75)
    assert not got["d"]["inside"] and math.isnan(got["d"]["recovered"])
    windows = spark.createDataFrame(
        [("c", 1, 0.5), ("c", 1, 0.5), ("c", 16, 0.8), ("c", 16, 0.9)],
        "config string, window int, f double",
    )
    verdict = R.ablation_verdict(windows, ["config"], "f", 1, 16).first()
    assert verdict["earned"] and verdict["gain"] == pytest.approx(0.35)


def test_run_comparison_flags_exact_equality(spark):
    rows = [("a", 0, 0.5), ("a", 1, 0.6), ("b", 0, 0.5), ("b", 1, 0.6000001), ("c", 0, 0.5)]
    df = spark.createDataFrame(rows, "run string, seed int, f double").selectExpr(
        "run", "'x' AS config", "'m' AS model", "0 AS client", "seed", "f"
    )
    got = {r["run"]: r["equals_reference"] for r in R.run_comparison(df, "a", "f").collect()}
    assert got == {"a": True, "b": False, "c": True}


def test_nonce_under_two_keys_is_fine(spark):
    df = spark.createDataFrame([("k1", 1), ("k2", 1), ("k1", 2), ("k1", 2)], "k string, n int")
    assert [tuple(r) for r in R.nonce_reuse(df, "k", "n").collect()] == [("k1", 2, 2)]


@pytest.mark.parametrize("n", [1, 2, 10, 11])
def test_nearest_rank_rounds_half_to_even(spark, n):
    values = [float(v) for v in range(n)]
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    got = R.nearest_rank_percentiles(df, ["k"], "v", [50, 95]).first()
    assert got["p50"] == values[round(0.5 * (n - 1))] and got["p95"] == values[round(0.95 * (n - 1))]


# --- parameters ---


def states(spark, rows):
    return spark.createDataFrame(rows, "client int, name string, pos int, value double")


def test_fedavg_weighs_by_sequences(spark):
    table = states(spark, [(0, "w", 0, 1.0), (1, "w", 0, 4.0), (2, "w", 0, 99.0)])
    counts = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "client int, n_k long")
    assert A.weighted_fedavg(table, counts).first()["value"] == pytest.approx(3.0)
    assert A.unweighted_average(table).first()["value"] == pytest.approx(104 / 3)


@pytest.mark.parametrize("counts", [[(0, 0), (1, 0)], [(0, -1), (1, 3)], [(0, 2)]])
def test_fedavg_refuses_bad_counts(spark, counts):
    table = states(spark, [(0, "w", 0, 1.0), (1, "w", 0, 4.0)])
    with pytest.raises(PySparkException):
        A.weighted_fedavg(table, spark.createDataFrame(counts, "client int, n_k long")).collect()


def test_fedavg_refuses_missing_parameters(spark):
    table = states(spark, [(0, "w", 0, 1.0), (1, "w", 0, 4.0), (1, "b", 0, 4.0)])
    counts = spark.createDataFrame([(0, 1), (1, 1)], "client int, n_k long")
    with pytest.raises(PySparkException, match="do not all report"):
        A.weighted_fedavg(table, counts).collect()
    assert [tuple(r) for r in A.alignment_errors(table).collect()] == [(0, "b", 0)]


def test_counters_come_from_the_first_client(spark):
    table = states(spark, [(1, "steps", 0, 7.0), (0, "steps", 0, 5.0)]).withColumn(
        "is_float", F.lit(False)
    )
    counts = spark.createDataFrame([(0, 1), (1, 9)], "client int, n_k long")
    assert A.weighted_fedavg(table, counts).first()["value"] == 5.0


def test_fedprox(spark):
    local = states(spark, [(0, "w", 0, 1.0), (0, "w", 1, 3.0)])
    shared = states(spark, [(9, "w", 0, 0.0), (9, "w", 1, 1.0)]).drop("client")
    assert A.fedprox_penalty(local, shared, 0.5).first()["penalty"] == pytest.approx(1.25)
    with pytest.raises(ValueError):
        A.fedprox_penalty(local, shared, -1)
    with pytest.raises(PySparkException, match="match"):
        A.fedprox_penalty(local, shared.where("pos = 0"), 0.5).collect()


# --- selection ---


def pruned(spark, relevance, close, tau=0.95):
    names = list(relevance)
    pairs = [(a, b, 1.0 if a == b else close.get(a + b, close.get(b + a, 0.1))) for a in names for b in names]
    got = L.prune_correlated(
        spark.createDataFrame(list(relevance.items()), "feature string, mi double"),
        spark.createDataFrame(pairs, "a string, b string, r double"), tau,
    )
    return "".join(sorted(r["feature"] for r in got.where("kept").collect()))


def test_pruning_keeps_the_more_relevant_twin(spark):
    assert pruned(spark, {"a": 0.1, "b": 0.2, "c": 0.0}, {"ab": 0.95}) == "bc"
    assert pruned(spark, {"a": 0.2, "b": 0.2, "c": 0.0}, {"ab": 0.95}) == "ac"


def test_pruning_follows_chains_of_near_copies(spark):
    relevance = {c: 1.0 - i / 10 for i, c in enumerate("abcdefg")}
    chain = {a + b: 0.99 for a, b in zip("abcdef", "bcdefg", strict=True)}
    assert pruned(spark, relevance, chain) == "aceg"
    rng = random.Random(3)
    for _ in range(3):
        names = "abcdefgh"
        relevance = {c: rng.choice([0.1, 0.2, 0.3]) for c in names}
        close = {a + b: rng.choice([0.5, 0.97]) for a in names for b in names if a < b}
        kept = []
        for c in sorted(names, key=lambda c: (-relevance[c], c)):
            if all(close[min(c, k) + max(c, k)] < 0.95 for k in kept):
                kept.append(c)
        assert pruned(spark, relevance, close) == "".join(sorted(kept))


def plain_knn(x, y, k):
    """The estimate from all distances."""
    x, y = np.asarray(x, float), np.asarray(y)
    counts = Counter(y.tolist())
    keep = np.array([counts[label] > 1 for label in y.tolist()])
    x, y = x[keep], y[keep]
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    total = 0.0
    for i in range(len(x)):
        away = np.abs(x - x[i])
        same = np.sort(np.delete(away, i)[np.delete(y, i) == y[i]])
        own = min(k, len(same))
        reach = same[own - 1]
        m = int((away < reach).sum()) if reach > 0 else int((away == 0).sum())
        total += psi(own) - psi(len(same) + 1) - psi(m)
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("bits", [2, 5, 18])
@pytest.mark.parametrize("neighbours", [1, 3, 7])
def test_neighbour_information_equals_all_pairs(spark, bits, neighbours):
    rng = np.random.default_rng(bits)
    n = 240
    y = np.array(["hot"] * 100 + ["b"] * 80 + ["c"] * 52 + ["d"] * 5 + ["two"] * 2 + ["one"])
    columns = {
        "close": (y == "hot") * 2.0 + rng.normal(size=n), "noise": rng.normal(size=n) * 1e-9,
        "ties": rng.integers(-3, 4, n).astype(float), "third": np.where(np.arange(n) % 3 == 0, 0.0, rng.normal(size=n)),
        "wide": 10.0 ** rng.integers(-300, 300, n) * rng.choice([-1, 1], n),
    }
    rows = [(str(label), *[float(c[i]) for c in columns.values()]) for i, label in enumerate(y)]
    rows += [("b", *[math.nan] * 5), (None, *[1.0] * 5), ("c", math.inf, *[0.0] * 4)]
    schema = "label string, " + ", ".join(f"{c} double" for c in columns)
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = {r["feature"]: r["mi"] for r in V.mutual_information_knn(df, list(columns), "label", neighbours, bits).collect()}
    for name, values in columns.items():
        assert got[name] == pytest.approx(plain_knn(values, y, neighbours), abs=1e-9)


def test_interval_of_nearer_doubles_has_exact_ends():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=300), [0.0, -0.0, 1.0, 1e300, -1e-320, 5e-324]))
    reach = np.concatenate((10.0 ** rng.uniform(-30, 10, 300), [0.0, 0.0, 1.0, 1e290, 1e-5, 1.0]))
    first, past = V.nearer_than(x, reach)
    reach = np.maximum(reach, 5e-324)
    assert (np.abs(first - x) < reach).all() and (np.abs(np.nextafter(first, -np.inf) - x) >= reach).all()
    assert (np.abs(past - x) >= reach).all() and (np.abs(np.nextafter(past, -np.inf) - x) < reach).all()


def test_digamma(spark):
    got = [r[0] for r in spark.range(1, 400).select(V.digamma(F.col("id"))).collect()]
    expected = np.cumsum([-0.5772156649015329, *[1 / i for i in range(1, 399)]])
    assert np.allclose(got, expected, rtol=0, atol=1e-12)


def test_mutual_information_of_a_copy_is_the_entropy(spark):
    df = spark.range(400).select((F.col("id") % 4).alias("a"), (F.col("id") % 4).alias("y"),
                                 F.lit(1).alias("flat"))
    got = {r[0]: r[1] for r in V.mutual_information(df, ["a", "flat"], "y").collect()}
    assert got["a"] == pytest.approx(math.log(4)) and got["flat"] == pytest.approx(0.0)


@pytest.mark.parametrize(
    ("scores", "at"), [([0.1, 0.9], 1), ([0.5, 0.5], 0), ([0, 0.8, 0.9, 1.0], 1), ([0, 1, 2], 0)]
)
def test_knee(spark, scores, at):
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(scores)],
                               "series string, i int, v double")
    assert L.knee(df, "series", "i", "v").first()["knee_index"] == at


def labelled(spark):
    noise = (F.xxhash64("id") % 1000) / 1000.0
    y = F.col("id") % 3
    return spark.range(600).select(
        "id",
        F.concat(F.lit("c"), y.cast("string")).alias("label"),
        (y * 3 + noise).alias("informative_a"),
        (F.when(y == 2, 4).otherwise(0) + F.sin("id")).alias("informative_b"),
        ((y * 3 + noise) * 2).alias("copy_of_a"),
        noise.alias("noise"),
        F.lit(1.0).alias("constant"),
        F.lit("f").alias("source_file"),
    )


def names_of(table, condition, order="place"):
    return [r["feature"] for r in table.where(condition).orderBy(order).collect()]


def test_selection_stages(spark):
    table, tried = L.select_features(labelled(spark), "label", "id", 0.95, 2, trees=10)
    assert names_of(table, "NOT candidate") == ["constant", "source_file"] and tried is None
    # The twins tie, so the name decides.
    assert names_of(table, "candidate AND NOT kept") == ["informative_a"]
    selected = L.selected_names(table)
    assert selected[0] == "copy_of_a" and len(selected) == 2
    assert names_of(table, "kept", "fused_rank")[-1] == "noise"
    assert table.where("NOT kept AND fused_rank IS NOT NULL").isEmpty()
    assert names_of(table, "disputed") == names_of(table, "(mi_rank <= 2) <> (forest_rank <= 2)")


def test_selection_sweep_adds_the_full_set_and_takes_the_knee(spark):
    seen = []

    def evaluator(columns):
        seen.append(len(columns))
        return {1: 0.2, 2: 0.9, 3: 0.91}[len(columns)]

    table, tried = L.select_features(
        labelled(spark), "label", "id", 0.95, 1, sizes=[1, 2, 50], evaluator=evaluator,
        trees=5, forest_rows=300,
    )
    assert seen == [1, 2, 3] and len(L.selected_names(table)) == 2
    assert [tuple(r) for r in tried.orderBy("n_features").collect()] == [(1, 0.2, False), (2, 0.9, True), (3, 0.91, False)]


def test_selection_leaves_out_rows_that_are_not_finite(spark):
    noise = F.when(F.col("id") % 5 == 0, float("nan")).otherwise(F.col("noise"))
    table, _ = L.select_features(labelled(spark).withColumn("noise", noise), "label", "id", 0.95, 2, trees=5)
    whole, _ = L.select_features(labelled(spark).where("id % 5 <> 0"), "label", "id", 0.95, 2, trees=5)
    mi = lambda t: {r["feature"]: r["mi"] for r in t.collect()}
    assert mi(table) == mi(whole)


def test_selection_refuses_unusable_frames(spark):
    with pytest.raises(ValueError, match="no column"):
        L.select_features(labelled(spark).select("id", "label", "constant"), "label", "id", 0.9, 1)
    bad = labelled(spark).withColumn("noise", F.lit(None).cast("double") + F.col("id"))
    with pytest.raises(ValueError):
        L.select_features(bad.select("id", "label", "noise"), "label", "id", 0.9, 1)
    odd = F.col("id") % 2 == 1
    apart = labelled(spark).select(
        "id", "label", F.when(odd, F.col("noise")).alias("x"), F.when(~odd, F.col("noise")).alias("y")
    )
    with pytest.raises(ValueError, match="no row"):
        L.select_features(apart, "label", "id", 0.9, 1)
    with pytest.raises(ValueError, match="tau"):
        L.select_features(labelled(spark), "label", "id", 0.0, 1)
