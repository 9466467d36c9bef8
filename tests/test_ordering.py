"""Chunked order work equals plain windows, wherever the chunks and partitions fall."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions.draws import draw
from tidewatch.operators import ordering as O
from tidewatch.operators import sequences as S
from tidewatch.operators import split


def skewed_rows(spark, n=600, seed=1):
    """One key holds more than a third of the rows."""
    rng = random.Random(seed)
    rows = [
        (i * 3 + rng.randrange(3), rng.choice("aaabcd"), rng.randrange(50), rng.choice("xy"))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "pos long, key string, v long, label string")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bits", [2, 5, 18])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_running_equals_windows(spark, bits, keys):
    df = skewed_rows(spark)
    w = Window.partitionBy(*keys).orderBy("pos")
    expected = df.select(
        "pos",
        F.row_number().over(w).cast("long").alias("n"),
        (F.row_number().over(w) - 1).cast("long").alias("n0"),
        F.sum("v").over(w).alias("s"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
        F.lag("label").over(w).alias("before"),
    )
    got = O.by_position(
        df,
        keys,
        "pos",
        {
            "n": O.running_count(),
            "n0": O.running_count(inclusive=False),
            "s": O.running_sum(F.col("v")),
            "m": O.running_max(F.col("v"), inclusive=False),
            "before": O.previous(F.col("label")),
        },
        bits,
    ).select(*expected.columns)
    assert rows_of(got) == rows_of(expected)


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_results_do_not_depend_on_partitioning(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = skewed_rows(spark).repartition(partitions)
        blocks = split.pooled_blocks(df, "label", "pos", 16, bits=4).drop("pos")
        sided = split.stratified_block_split(blocks.withColumn("id", F.col("v")), "label", 0.3, 7)
        result = rows_of(sided)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    reference = split.stratified_block_split(
        split.pooled_blocks(skewed_rows(spark), "label", "pos", 16).drop("pos")
        .withColumn("id", F.col("v")), "label", 0.3, 7,
    )
    assert result == rows_of(reference)


@pytest.mark.parametrize("ranks", [[0], [1], [5, 40], [10_000]])
def test_draw_cutoffs_are_order_statistics(spark, ranks):
    df = skewed_rows(spark)
    order = draw(3, "pos")
    cutoffs = O.draw_cutoffs(
        df, ["key"], order, lambda n: F.array(*[F.least(n, F.lit(r).cast("long")) for r in ranks])
    )
    got = {r["key"]: r["cutoffs"] for r in cutoffs.collect()}
    by_key = {}
    for r in df.select("key", order.alias("d")).collect():
        by_key.setdefault(r["key"], []).append(r["d"])
    for key, draws in by_key.items():
        draws.sort()
        expected = ["" if r == 0 else draws[min(r, len(draws)) - 1] for r in ranks]
        assert got[key] == expected


@pytest.mark.parametrize("rows_per_chunk", [7, 100, 1 << 18])
def test_at_ranks_with_a_hot_value(spark, rows_per_chunk):
    rng = random.Random(2)
    rows = [("ab"[rng.randrange(2)], 1.5 if rng.random() < 0.4 else rng.random() * 9)
            for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {
        r["k"]: (r["n"], r["mid"], r["top"])
        for r in O.at_ranks(
            df, ["k"], "x", {"mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1},
            rows_per_chunk,
        ).collect()
    }
    for key in "ab":
        values = sorted(x for k, x in rows if k == key)
        assert got[key] == (len(values), values[len(values) // 2], values[-1])


def test_bounded_table_leaves_large_tables_alone(spark):
    assert O.bounded_table(spark.range(10), 10).count() == 10
    large = spark.range(11)
    assert O.bounded_table(large, 10) is large


def brute_windows(rows, window):
    """Same-source neighbours with one label, by plain loops."""
    at = {(k, p): (v, lab) for p, k, v, lab in rows}
    out = []
    for (key, pos), (_, label) in at.items():
        frame = [at.get((key, pos - i)) for i in range(window - 1, -1, -1)]
        if all(f is not None and f[1] == label for f in frame):
            out.append((key, pos, label, [[float(f[0])] for f in frame]))
    return sorted(out)


@pytest.mark.parametrize("bits", [3, 6, 18])
@pytest.mark.parametrize("window", [1, 2, 4])
def test_train_windows_equal_brute_force(spark, bits, window):
    rng = random.Random(5)
    rows, at = [], {}
    for _ in range(400):
        key = rng.choice("aaab")
        at[key] = at.get(key, -1) + (1 if rng.random() < 0.9 else 2)
        rows.append((at[key], key, rng.randrange(9), rng.choice("xxxy")))
    df = spark.createDataFrame(rows, "pos long, key string, v long, label string")
    got = S.train_windows(df, "key", "pos", "label", ["v"], window, bits=bits)
    assert sorted((r[0], r[1], r[2], [list(x) for x in r[3]]) for r in got.collect()) == (
        brute_windows(rows, window)
    )
    if window > 1:
        counted = S.count_sequences(S.runs(df, "key", "pos", "label", bits), window).first()[0]
        assert counted == len(brute_windows(rows, window))


@pytest.mark.parametrize("bits", [2, 4, 18])
def test_make_blocks_equals_sequential_scan(spark, bits):
    rng = random.Random(9)
    labels, current = [], "a"
    for _ in range(300):
        current = rng.choice("ab") if rng.random() < 0.1 else current
        labels.append(current)
    df = spark.createDataFrame(list(enumerate(labels)), "pos long, label string")
    expected, block, filled = [], 0, 0
    for i, label in enumerate(labels):
        if i and (label != labels[i - 1] or filled == 7):
            block, filled = block + 1, 0
        expected.append(block)
        filled += 1
    got = split.make_blocks(df, "label", "pos", 7, bits).orderBy("pos").collect()
    assert [r["block_id"] for r in got] == expected


@pytest.mark.parametrize("bits", [3, 18])
@pytest.mark.parametrize("window", [2, 3, 5])
def test_latency_windows_equal_brute_force(spark, bits, window):
    rng = random.Random(4)
    labels = []
    while len(labels) < 200:
        labels += [rng.choice(["benign", "dos", "scan"])] * rng.randrange(1, 6)
    runs, start = [], 0
    for i in range(1, len(labels) + 1):
        if i == len(labels) or labels[i] != labels[start]:
            runs.append((start, i))
            start = i
    expected = []
    for (s0, _), (s1, e1) in zip(runs, runs[1:]):
        if labels[s0] != "benign" or labels[s1] == "benign":
            continue
        for past in range(1, window):
            end = s1 + past - 1
            if end - window + 1 >= s0 and end < e1:
                expected.append((end, s1, past))
    df = spark.createDataFrame(
        [("s", i, lab, float(i)) for i, lab in enumerate(labels)],
        "source string, pos long, label string, x double",
    )
    got = S.latency_windows(df, "source", "pos", "label", ["x"], window, "benign", bits=bits)
    found = got.collect()
    assert sorted((r["pos"], r["boundary"], r["past"]) for r in found) == sorted(expected)
    for r in found:
        assert [x[0] for x in r["window"]] == [
            float(i) for i in range(r["pos"] - window + 1, r["pos"] + 1)
        ]


def test_ordered_image_keeps_the_order_of_doubles(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    bits = rng.integers(-(2**63), 2**63, 4000, dtype=np.int64).view(np.float64)
    exact = [0.0, -0.0, 1.0, -1.0, float("inf"), float("-inf"), 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.7976931348623157e308]
    powers = np.concatenate([(2.0**e, np.nextafter(2.0**e, 0), np.nextafter(2.0**e, np.inf)) for e in range(-1060, 1023, 7)])
    values = np.concatenate((bits[~np.isnan(bits)], exact, powers, -powers))
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = df.select("v", O.ordered_image(F.col("v")).alias("i")).collect()
    for r in got:
        whole = int(np.array([r["v"] + 0.0]).view(np.int64)[0])
        assert r["i"] == (whole if whole >= 0 else -(whole + 2**63))
    odd = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "v double")
    nan, null, inf = (r[0] for r in odd.select(O.ordered_image(F.col("v"))).collect())
    assert nan > inf and null is None


@pytest.mark.parametrize("partitions", [1, 7])
def test_in_order_numbers_rows_of_any_order(spark, partitions):
    df = skewed_rows(spark).repartition(partitions)
    got = O.in_order(df, F.col("key"), F.col("v").desc(), F.col("pos")).collect()
    expected = sorted(got, key=lambda r: (r["key"], -r["v"], r["pos"]))
    assert [r["at"] for r in expected] == list(range(600))
    assert O.in_order(df.limit(0), F.col("key")).count() == 0


@pytest.mark.parametrize("rows_per_bucket", [1, 40, 1 << 18])
def test_at_ranks_refines_crowded_buckets(spark, rows_per_bucket):
    rng = random.Random(5)
    odd = [0.0, -0.0, float("inf"), float("-inf"), float("nan"), None, 5e-324]
    rows = [(k, v) for k in ("a", None) for v in odd]
    rows += [(rng.choice("ab"), 1.0 + rng.randrange(90) * 2.0**-50) for _ in range(400)]
    df = spark.createDataFrame(rows, "key string, v double").repartition(3)
    got = O.at_ranks(df, ["key"], "v", {"low": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "top": lambda n: n - 1}, rows_per_bucket)
    order = lambda v: (v != v, 0.0 if v != v else v)
    for r in got.collect():
        own = sorted((v for k, v in rows if k == r["key"] and v is not None), key=order)
        assert r["n"] == len(own)
        for name, at in (("low", 0), ("mid", len(own) // 2), ("top", len(own) - 1)):
            assert order(r[name]) == order(own[at])
