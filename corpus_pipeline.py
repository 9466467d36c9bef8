"""A corpus from raw documents to token ids, in stages that are written and read again.

Each stage takes (spark, docs, folder of the tables) and returns documents, the last one encoded
documents. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bpe, jaccard, line_dedup, mixing
from tidewatch.llm import toxicity as toxicity_model
from tidewatch.llm.common import same_document, table
from tidewatch.session import run_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    model = toxicity_model.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = toxicity_model.score_toxicity(docs, model, *COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays."""
    kept = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs), [c for c in COLUMNS if c != "text"])
    changed = F.col("n_dropped") > 0
    return kept.select(
        "doc_id", F.col("kept_text").alias("text"), "lang", "source",
        F.when(changed, F.char_length("kept_text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"),
    )


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once."""
    groups = jaccard.jaccard_groups(docs).where(F.col("component_id").eqNullSafe(F.col("doc_id")))
    chosen = groups.select("doc_id", "text_key").distinct()
    both = with_key(docs).alias("d").join(chosen.alias("c"), same_document("d", "c"), "left_semi")
    return both.dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs).groupBy("doc_id", "text_key", "source").agg(F.sum("copies").alias("copies"))
    one = with_key(docs).dropDuplicates(["doc_id", "text_key", "source"]).alias("d")
    both = one.join(
        mixed.where("copies > 0").alias("m"),
        same_document("d", "m") & F.col("d.source").eqNullSafe(F.col("m.source")),
    )
    copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return both.select(*[f"d.{c}" for c in COLUMNS], copies).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of what they decode to."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), "doc_id", "lang", "source")
    return coded.select(
        "doc_id", "lang", "source", "n_tokens", "ids",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup_stage),
    ("jaccard_join", jaccard_join),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Scores of a fitted classifier are beyond SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = run_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
