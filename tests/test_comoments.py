"""Co-moments against numpy, on uneven parts and values far from 0."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import comoments as M
from tidewatch.operators import profile as P


@pytest.mark.parametrize("fan", [(16, 16 << 20), (2, 1)])
@pytest.mark.parametrize("parts", [1, 13])
def test_co_moments_equal_numpy(spark, fan, parts, monkeypatch):
    monkeypatch.setattr(M, "FAN", fan[0])
    monkeypatch.setattr(M, "DRIVER_BYTES", fan[1])
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 5))
    x[:, 1] = 1e9 + 1e-3 * x[:, 0] + 1e-4 * x[:, 1]
    x[:, 2] = 7.25
    x[:, 3] = -x[:, 0]
    # All but a few rows lie in one part.
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    df = df.repartition(parts, F.when(F.col("i") < 600, 0).otherwise(F.col("i")))
    away = x - x[0]
    away = away - away.mean(axis=0)
    expected = away.T @ away
    for far in (False, True):
        got = M.co_moments(df, F.col("v"), 5, far)
        base = got.low - x.min(axis=0)
        assert got.n == 700 and np.allclose(got.mean - base, x.mean(axis=0), rtol=1e-12)
        near = [0, 3, 4]
        assert np.allclose(got.moment[near][:, near], expected[near][:, near], rtol=1e-12)
        r = got.correlation()
        assert (r[2] == [0, 0, 1, 0, 0]).all() and r[0, 3] == pytest.approx(-1, abs=1e-14)
        # The second column's spread is a millionth of a millionth of its mean.
        digits = 1e-12 if far else 1e-6
        assert r[0, 1] == pytest.approx(expected[0, 1] / np.sqrt(expected[0, 0] * expected[1, 1]), abs=digits)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert M.co_moments(empty, F.array("a", "b"), 2) is None
    assert {r["r"] for r in P.pearson_matrix(empty, ["a", "b"]).where("a <> b").collect()} == {0.0}


def test_rank_correlation_of_many_columns_with_hot_values(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 12))
    x[:, 1] = np.where(np.arange(400) % 3 == 0, 0.0, x[:, 1])
    x[:, 2] = np.exp(x[:, 0])
    x[:, 3] = rng.integers(0, 3, 400)
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], ", ".join(f"{c} double" for c in names)).repartition(5)

    def ranks(v):
        return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])

    expected = np.abs(np.corrcoef(np.stack([ranks(c) for c in x.T])))
    for bits in (4, 18):
        got = {(r["a"], r["b"]): r["r"] for r in P.spearman_matrix(df, names, bits).collect()}
        assert all(got[a, b] == pytest.approx(expected[i, j], abs=1e-12) for i, a in enumerate(names) for j, b in enumerate(names))
