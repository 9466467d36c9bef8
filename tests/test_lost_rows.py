"""Nothing is lost without a word: null labels, null values, tables kept as folders."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import metrics as M
from tidewatch.operators import parameters as P
from tidewatch.operators import profile as A
from tidewatch.operators import report as R
from tidewatch.operators import sampling as S
from tidewatch.operators import scaling as C
from tidewatch.operators import split as B
from tidewatch.operators.ordering import at_ranks
from tidewatch.plans import QUERIES


def labelled(spark):
    return spark.range(100).select(
        F.col("id").alias("row"), F.when(F.col("id") % 10 < 7, "a").alias("label")
    )


def test_null_label_keeps_its_rows_when_trimmed(spark):
    got = S.trim_to_cap(labelled(spark), "label", "row", 20, 0).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {"a": 20, None: 20}


def test_null_label_is_not_dropped_by_a_split(spark):
    blocks = labelled(spark).withColumn("block_id", F.col("row"))
    cutoffs = B.fit_block_split(blocks.where("label IS NOT NULL"), "label", 0.2, 0)
    with pytest.raises(Exception, match="no cutoffs for the label null"):
        B.assign_side(blocks, cutoffs, "label", 0).collect()


@pytest.mark.parametrize("rows_per_chunk", [7, 1 << 18])
def test_nulls_have_no_rank(spark, rows_per_chunk):
    df = spark.range(300).select(F.when(F.col("id") >= 40, F.col("id").cast("double")).alias("v"))
    got = at_ranks(df, [], "v", {"mid": lambda n: F.floor(n / 2)}, rows_per_chunk).first()
    assert (got["n"], got["mid"]) == (260, 170.0)


@pytest.mark.parametrize("rows_per_chunk", [7, 1 << 18])
def test_average_precision_leaves_out_unscored_rows(spark, rows_per_chunk):
    score = F.when(F.col("id") % 5 > 0, F.col("id") % 17)
    df = spark.range(200).select((F.col("id") % 3 == 0).alias("t"), score.alias("s"))
    full = M.average_precision(df.dropna(), "t", "s").first()["pr_auc"]
    got = M.average_precision(df, "t", "s", rows_per_chunk).first()["pr_auc"]
    assert got == pytest.approx(full)


def test_streams_read_a_table_kept_as_a_folder(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    counts = [
        sorted(map(tuple, QUERIES["route_counts_stream"](spark, where).collect()))
        for where in (folder, str(tmp_path))
    ]
    assert counts[0] == counts[1] and counts[0]
    with pytest.raises(Exception, match="does not exist"):
        QUERIES["route_counts_stream"](spark, f"{tmp_path}/none")


def test_a_constant_correlates_with_nothing(spark):
    df = spark.range(1000, numPartitions=7).select(F.lit(0.1).alias("c"), F.rand(1).alias("x"))
    assert {r["r"] for r in A.pearson_matrix(df, ["c", "x"]).where("a <> b").collect()} == {0.0}


def test_nothing_to_combine_is_an_error(spark):
    parts = spark.createDataFrame([], "client int, feature string, count long, mean double, m2 double")
    with pytest.raises(ValueError, match="rows to combine"):
        C.combine_stats(parts)


def test_averages_keep_the_type_of_the_parameters(spark):
    rows = spark.createDataFrame([(0, "w", 0, 1.0), (1, "w", 0, 2.0)], "client int, name string, pos int, value float")
    counts = spark.createDataFrame([(0, 1), (1, 3)], "client int, n_k int")
    got = P.weighted_fedavg(rows, counts)
    assert got.schema["value"].dataType.simpleString() == "float" and got.first()["value"] == 1.75


def test_run_comparison_ranges_over_clients(spark):
    rows = [("r", "c", "m", client, seed, client * 10.0 + seed) for client in (0, 1) for seed in (0, 2)]
    df = spark.createDataFrame(rows, "run string, config string, model string, client int, seed int, f double")
    got = {(r["client"], r["mean"], r["least"], r["most"]) for r in R.run_comparison(df, "r", "f").collect()}
    assert got == {(0, 1.0, 1.0, 11.0), (1, 11.0, 1.0, 11.0)}
