"""A sharded Bloom filter as a table: which rows cannot have a partner goes before the shuffle.

A shard is a row with an array of words. Rows find their shard and test their bits by built-in
functions, so the filter costs a broadcast join of bounded size and no shuffle. It lets some rows
pass that have no partner, never the other way round: an exact join has to follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES = 12, 6
#: Words of 64 bits in a shard.
SHARD_WORDS = 1 << 14
#: What all shards may hold together; more keys make the filter weaker, not larger.
FILTER_BYTES = 32 << 20


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(HASHES), key), F.lit(shards)).cast("int")


def _bit(key: Column, number: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(number), key), F.lit(64 * SHARD_WORDS)).cast("int")


def bloom_filter(keys: DataFrame, key: str, n: int) -> DataFrame:
    """(shard, words) over the ``n`` distinct values of ``key``."""
    shards = min(-(-n * BITS_PER_KEY // (64 * SHARD_WORDS)) or 1, FILTER_BYTES // (8 * SHARD_WORDS))
    places = F.explode(F.array(*[_bit(F.col(key), i) for i in range(HASHES)])).alias("bit")
    hit = keys.select(_shard(F.col(key), shards).alias("shard"), places).select(
        "shard", F.expr("shiftright(bit, 6)").alias("word"), F.expr("shiftleft(1L, bit & 63)").alias("bits")
    )
    # Words without a key are there as well, so that a word is found by its place.
    zeros = keys.sparkSession.range(shards * SHARD_WORDS).select(
        F.floor(F.col("id") / SHARD_WORDS).cast("int").alias("shard"),
        F.pmod("id", F.lit(SHARD_WORDS)).cast("int").alias("word"), F.lit(0).cast("long").alias("bits"),
    )
    words = hit.unionByName(zeros).groupBy("shard", "word").agg(F.bit_or("bits").alias("bits"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return words.groupBy("shard").agg(F.transform(ordered, lambda w: w["bits"]).alias("words"))


def may_contain(df: DataFrame, key: str, bloom: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``key`` may be in the filter, which is broadcast."""
    shards = bloom.count()
    shard = bloom.withColumnsRenamed({"shard": "__shard", "words": "__words"})
    met = df.withColumn("__shard", _shard(F.col(key), shards)).join(F.broadcast(shard), "__shard")
    held = F.lit(True)
    for i in range(HASHES):
        bit = _bit(F.col(key), i)
        word = F.get("__words", F.shiftright(bit, 6))
        held = held & (F.getbit(word, bit.bitwiseAND(63)) == 1)
    return met.where(held).drop("__shard", "__words")
