"""N-gram Jaccard join by token-combination prefixes.

A token is a shingle of five words; documents with equal sets are one set. In any order of tokens
common to all sets, two sets with overlap of at least t share l tokens among the first
|x| - t + l of x and |y| - t + l of y. Tokens are ordered by hash, but those of the frequent class
come last. So two sets that share any rare token share one among the first |x| - t + 1 of each, and
sets that share none have t frequent tokens in common, so that their rare ones do not fill such a
prefix. A set is indexed by

* each rare token among its first |x| - t + 1 alone, and
* if its rare tokens do not fill that, each pair of frequent tokens among its first |x| - t + b + 1
  that lie in the same of b hash buckets: b + 1 are shared, and two of them share a bucket.

The number of buckets follows the smaller of two set sizes, so a set is indexed for one or two numbers.
Frequent tokens never open a posting list alone: what refills a prefix is counted like what was in it,
until no token of a list is held by more than about ``FREQUENT`` sets. And no list of pairs grows with
the square of a prefix. Tokens that refill are mostly among those kept with the prefix; only sets that
use these up are read again from their texts.

Components need not all pairs of a posting list. First each set is verified against the set it
shares most lists with, of the heads of its lists: the set that shares most of all, which in a group of
near copies is one with few edits. Long lists that still lie in several components are gone through
again, each set against the next head, as long as that finds links; this joins large groups of near
copies by about as many checks as they have members. Then every pair that still shares a list across two
components, and whose sizes allow the link, is verified; a pair that shares several long lists
comes from the longest of them. Verification first compares parity bitmaps, then longer ones
(a bit for each hash bucket: is the number of its tokens odd?): sets differ in at least as many
tokens as their bitmaps in bits, so pairs too far apart go without their sets being moved. The
others are decided by counting the common tokens of both whole sets.

Distinct sets are the nodes. An id whose rows have several texts links their sets, and a component
is named by the smallest id of any of its sets.

Defined results: texts that are null or without words have size 0 and link with nothing. With fewer
than five words the whole sequence is one token. Rows without id link with nothing and have no
component. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import keyed, map_batches
from tidewatch.llm.components import connected_components
from tidewatch.llm.shingles import mix, shingle_hashes
from tidewatch.operators.bloom import bloom_filter, may_contain
from tidewatch.session import cut_lineage, release

#: A token that more sets hold in their prefixes is of the frequent class. A token that one set alone held
#: before others took it may be counted one short.
FREQUENT = 64
#: A list of more sets is a long one. Of a set's longest, so many tell which pairs another list has.
LONG, FIRST = 256, 8
#: Rounds of checks against heads, at most; pairs that these do not join are verified one by one.
ROUNDS = 4
#: Times the length of a set's bitmap, for sets that pass by their bitmaps: 16 to 32 bits a token.
WIDE = 8


def needed(n: int) -> int:
    """The least overlap of a set of ``n`` tokens with any set it can link to, at 80 of 100."""
    return (4 * n + 4) // 5


def level(n: int) -> int:
    """log2 of the number of buckets for the smaller size ``n``: about n / 16 buckets."""
    return max(0, (n // 16).bit_length() - 1)


def prefix_length(n: int, level: int) -> int:
    return min(n, n - needed(n) + (1 << level) + 1)


def rare_length(n: int) -> int:
    """So many tokens of a set, the rare first, hold one that any linked set has among as many of its own."""
    return min(n, n - needed(n) + 1)


def parity_bits(tokens: np.ndarray, times: int = 1) -> bytes:
    """A parity bitmap of 64 bits for each bucket of the set's level, 128 at least, or ``times`` as many."""
    size = times * max(128, 64 << level(len(tokens)))
    counts = np.bincount((mix(tokens.view(np.uint64)) % np.uint64(size)).astype(np.int64), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def too_far(x: bytes, n: int, y: bytes, m: int) -> bool:
    """If the bitmaps alone show that two sets differ in more tokens than a link allows."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    # Sizes are powers of two: a longer bitmap folds onto a shorter one.
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (a, b))
    return 9 * int(np.bitwise_count(a ^ b).sum()) > n + m


def _sets(rows: dict) -> dict:
    out = {"doc_id": rows["doc_id"], "text_key": rows["text_key"], "n": [], "s1": [], "s2": [], "bits": [], "prefix": [], "ahead": []}
    for text in rows["text"]:
        tokens = shingle_hashes(text)
        n = len(tokens)
        wide = tokens.view(np.uint64)
        out["n"].append(n)
        out["s1"].append(int(wide.sum(dtype=np.uint64).view(np.int64)))
        out["s2"].append(int(mix(wide).sum(dtype=np.uint64).view(np.int64)))
        out["bits"].append(parity_bits(tokens))
        length = rare_length(n)
        out["prefix"].append(tokens[:length])
        out["ahead"].append(tokens[length : length + length // 4 + 32])
    return out


def token_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, s1, s2, bits, prefix, ahead): size, two hashes of the set, its parity bitmap,
    its prefix by hash and some tokens that follow it."""
    return map_batches(
        keyed(docs), _sets,
        "doc_id long, text_key long, n int, s1 long, s2 long, bits binary, prefix array<long>, ahead array<long>",
    )


def _all_tokens(rows: dict) -> dict:
    return {"rep": rows["rep"], "tokens": [shingle_hashes(t) for t in rows["text"]]}


def _wide_bits(rows: dict) -> dict:
    tokens = [shingle_hashes(t) for t in rows["text"]]
    return {"rep": rows["rep"], "n": [len(t) for t in tokens], "bits": [parity_bits(t, WIDE) for t in tokens]}


def wide_bits_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, n, bits) of the sets ``reps``, as a cut table: bitmaps ``WIDE`` times as long."""
    return of_texts(docs, reps, _wide_bits, "rep long, n int, bits binary", "wide-bits")


def tokens_of(docs: DataFrame, reps: DataFrame, purpose: str) -> DataFrame:
    """(rep, tokens) of the sets ``reps``, as a cut table."""
    return of_texts(docs, reps, _all_tokens, "rep long, tokens array<long>", purpose)


def of_texts(docs: DataFrame, reps: DataFrame, rows: Callable[[dict], dict], schema: str, purpose: str) -> DataFrame:
    """What ``rows`` makes of the texts of ``reps``, each read from its document (doc_id, text_key), as a cut table.

    Other texts go before any is moved. Texts are made unique where the join has put them, so that token
    arrays are not shuffled for it.
    """
    spark = docs.sparkSession
    wanted = reps.select("rep", "doc_id", "text_key")
    bloom = cut_lineage(spark, bloom_filter(wanted, "text_key", wanted.count()), "text-filter")
    own = may_contain(keyed(docs), "text_key", bloom).join(wanted, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])
    found = cut_lineage(spark, map_batches(own.select("rep", "text"), rows, schema), purpose)
    release(bloom)
    return found


def pair_signatures(n: int, n_rare: int, frequent: np.ndarray) -> np.ndarray:
    """The signatures of the pairs of frequent tokens that follow ``n_rare`` rare ones in a prefix."""
    found = [np.zeros(0, np.int64)]
    for one in range(level(needed(n)), level(n) + 1):
        # Frequent tokens come after all rare ones.
        left = max(0, prefix_length(n, one) - n_rare)
        tokens = frequent[:left].view(np.uint64)
        bucket = (mix(tokens) & np.uint64((1 << one) - 1)).astype(np.int64)
        for b in np.unique(bucket):
            held = tokens[bucket == b]
            i, j = np.triu_indices(len(held), 1)
            found.append(mix(mix(held[i] + np.uint64(one + 1)) + held[j]).view(np.int64))
    return np.unique(np.concatenate(found))


def _combinations(rows: dict) -> dict:
    out = {"rep": [], "n": [], "signature": []}
    for rep, n, n_rare, frequent in zip(rows["rep"], rows["n"], rows["n_rare"], rows["frequent"], strict=True):
        signatures = pair_signatures(n, n_rare, np.array(frequent, np.int64))
        out["signature"] += signatures.tolist()
        out["rep"] += [rep] * len(signatures)
        out["n"] += [n] * len(signatures)
    return out


def settled_prefixes(docs: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets whose prefix held a frequent token, with the prefix they end up with.

    Returns (rep, n, length, rare, frequent): the rare tokens of the prefix by hash, and the frequent ones among
    all tokens looked at; and the sets' ids (rep).

    In a round, sets that lost tokens of their prefix to the frequent class look at more, further on. Only
    these are counted anew, and tokens that now have more than ``FREQUENT`` sets leave all prefixes they
    are in. It ends when no prefix lacks a token, or has no more to take.
    """
    spark = docs.sparkSession
    base = reps.select("rep", F.explode("prefix").alias("token"))
    counts = base.groupBy("token").agg(F.count("*").alias("sets"))
    known = cut_lineage(spark, counts.where("sets > 1"), "shared-tokens")
    often = fresh = cut_lineage(spark, known.where(F.col("sets") > FREQUENT).select("token"), "frequent-tokens")
    written, looked_at, moved, state = [known, often], base, None, None
    empty = F.array().cast("array<bigint>")
    heads = reps.select("rep", F.concat("prefix", "ahead").alias("tokens"))
    began = (
        "rep", "doc_id", "text_key", "n", F.size("prefix").alias("length"), (F.size("prefix") + F.size("ahead")).alias("held"),
        F.size("prefix").alias("end"), F.col("lost").alias("frequent"),
    )
    while True:
        # What has become frequent, in all prefixes looked at so far.
        lost = looked_at.join(fresh, "token").select("rep", "token")
        if state is not None:
            # Of the last round's tokens, also those known to be frequent before.
            lost = lost.unionByName(taken.join(often, "token").select("rep", "token")).distinct()
        lost = cut_lineage(spark, lost.groupBy("rep").agg(F.collect_list("token").alias("lost")), "lost-tokens")
        old = state
        if old is None:
            rows = lost.join(reps, "rep").select(*began)
        else:
            first = lost.join(old, "rep", "left_anti").join(reps, "rep").select(*began)
            grown = old.join(lost, "rep", "left").join(added.select("rep", F.size("tokens").alias("more")), "rep", "left")
            rows = grown.select(
                "rep", "doc_id", "text_key", "n", "length", "held", (F.col("end") + F.coalesce("more", F.lit(0))).alias("end"),
                F.concat("frequent", F.coalesce("lost", empty)).alias("frequent"),
            ).unionByName(first)
        state = cut_lineage(spark, rows, "prefix-states")
        missing = F.least(F.col("length") - F.col("end") + F.size("frequent"), F.col("n") - F.col("end"))
        lacking = state.select("rep", "doc_id", "text_key", "n", "end", "held", missing.alias("missing")).where("missing > 0")
        lacking = cut_lineage(spark, lacking, "lacking-prefixes")
        near, far = lacking.where("end + missing <= held"), lacking.where("end + missing > held")
        newcomers = far if moved is None else far.join(moved.select("rep"), "rep", "left_anti")
        if not newcomers.isEmpty():
            tokens = tokens_of(docs, newcomers, "moved-tokens")
            moved = tokens if moved is None else moved.unionByName(tokens)
            written.append(tokens)
        # Some of what comes will be frequent as well, so more is looked at than is missing.
        added = near.join(heads, "rep").select("rep", F.expr("slice(tokens, end + 1, least(2 * missing + 32, held - end))").alias("tokens"))
        if moved is not None:
            more_of = far.join(moved, "rep").select("rep", F.expr("slice(tokens, end + 1, least(2 * missing + 32, n - end))").alias("tokens"))
            added = added.unionByName(more_of)
        added = cut_lineage(spark, added, "added-tokens")
        written += [lost, state, lacking, added]
        if added.isEmpty():
            break
        taken = added.select("rep", F.explode("tokens").alias("token"))
        more = cut_lineage(spark, taken.groupBy("token").agg(F.count("*").alias("sets")), "added-counts")
        both = known.join(more.select("token"), "token", "left_semi").unionByName(more)
        total = both.groupBy("token").agg(F.sum("sets").alias("sets")).where(F.col("sets") > FREQUENT).select("token")
        fresh = cut_lineage(spark, total.join(often, "token", "left_anti"), "frequent-tokens")
        known, often = known.unionByName(more), often.unionByName(fresh)
        looked_at = looked_at.unionByName(taken)
        written += [more, fresh]
    held = heads.join(state.where("end <= held"), "rep")
    if moved is not None:
        held = held.unionByName(moved.join(state.where("end > held"), "rep"))
    settled = held.select(
        "rep", "n", "length", F.expr("slice(array_except(slice(tokens, 1, end), frequent), 1, length)").alias("rare"),
        F.array_sort(F.array_distinct("frequent")).alias("frequent"),
    )
    settled = cut_lineage(spark, settled, "settled-prefixes")
    release(*written)
    return settled, settled.select("rep")


def signatures(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, n, signature) of every set, where some other set has the same signature."""
    spark = docs.sparkSession
    settled, moved = settled_prefixes(docs, reps)
    kept = reps.join(moved, "rep", "left_anti").select("rep", "n", F.explode("prefix").alias("signature"))
    single = kept.unionByName(settled.select("rep", "n", F.explode("rare").alias("signature")))
    shared = single.groupBy("signature").agg(F.count("*").alias("sets")).where("sets > 1").select("signature")
    shared = cut_lineage(spark, shared, "shared-signatures")
    # Only a set whose rare tokens do not fill a prefix can link without sharing one; all its tokens were looked at.
    short = settled.where("size(rare) < length AND size(frequent) > 1").select("rep", "n", F.size("rare").alias("n_rare"), "frequent")
    pairs = map_batches(short, _combinations, "rep long, n int, signature long")
    found = cut_lineage(spark, single.join(shared, "signature").select("rep", "n", "signature").unionByName(pairs), "signatures")
    release(settled, shared)
    return found


def _verify(rows: dict) -> dict:
    out = {"a": [], "b": []}
    for a, b, x, y in zip(rows["a"], rows["b"], rows["x"], rows["y"], strict=True):
        common = len(np.intersect1d(np.array(x, np.int64), np.array(y, np.int64), assume_unique=True))
        if 100 * common >= 80 * (len(x) + len(y) - common):
            out["a"].append(a)
            out["b"].append(b)
    return out


def _possible(rows: dict) -> dict:
    stay = [
        not too_far(x, n, y, m)
        for x, n, y, m in zip(rows["x"], rows["n"], rows["y"], rows["m"], strict=True)
    ]
    return {c: [v for v, s in zip(rows[c], stay, strict=True) if s] for c in ("a", "b")}


def possible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that the bitmaps of ``sets`` (rep, n, bits) do not rule out."""
    bits = (
        pairs.join(sets.select(F.col("rep").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m")), "b")
        .join(sets.select(F.col("rep").alias("a"), F.col("bits").alias("x"), "n"), "a")
        .select("a", "b", "x", "n", "y", "m")
    )
    return map_batches(bits, _possible, "a long, b long")


def sets_in(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, doc_id, text_key) of the sets in ``pairs`` (a, b)."""
    named = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()
    return reps.join(named, "rep").select("rep", "doc_id", "text_key")


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are similar enough.

    Few pairs pass both bitmaps and are too far apart all the same, so few token arrays are moved in vain.
    """
    spark = docs.sparkSession
    near = cut_lineage(spark, possible(pairs, reps), "near-pairs")
    if near.isEmpty():
        return near
    named = cut_lineage(spark, sets_in(near, reps), "near-sets")
    wide = wide_bits_of(docs, named)
    nearer = cut_lineage(spark, possible(near, wide), "nearer-pairs")
    release(near, wide)
    closest = cut_lineage(spark, sets_in(nearer, named), "nearer-sets")
    tokens = tokens_of(docs, closest, "near-tokens")
    both = (
        nearer.join(tokens.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b")
        .join(tokens.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a")
        .select("a", "b", "x", "y")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few pairs of sets at a time become Python objects.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = {
                    "a": part["a"].to_pylist(), "b": part["b"].to_pylist(),
                    "x": [v.values.to_numpy() for v in part["x"]], "y": [v.values.to_numpy() for v in part["y"]],
                }
                yield pa.RecordBatch.from_pydict(_verify(rows), schema=pa.schema({"a": pa.int64(), "b": pa.int64()}))

    found = cut_lineage(spark, both.mapInArrow(run, "a long, b long"), "verified-pairs")
    release(named, nearer, closest, tokens)
    return found


def sets_of_one_id(slim: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of an id that has several."""
    pairs = slim.where("doc_id IS NOT NULL AND n > 0").select("doc_id", "rep")
    several = pairs.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b < most")
    return pairs.join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def lists_across(placed: DataFrame) -> DataFrame:
    """``placed`` (signature, rep, n, sets, weight, component) of lists in several components, with the list's
    heaviest set as ``head`` and its ``head_component``. ``placed`` is released."""
    spark = placed.sparkSession
    top = F.max(F.struct("weight", "rep", "component")).alias("top")
    heads = placed.groupBy("signature").agg(top, F.min("component").alias("low"), F.max("component").alias("high"))
    heads = heads.where("low < high").select("signature", F.col("top.rep").alias("head"), F.col("top.component").alias("head_component"))
    heads = cut_lineage(spark, heads, "posting-heads")
    out = cut_lineage(spark, placed.join(heads, "signature"), "open-lists")
    release(placed, heads)
    return out


def pairs_with_heads(open_lists: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(a, b): each set, and the head in another component that it shares most lists with and was not tried with."""
    votes = open_lists.where("component <> head_component").groupBy(F.col("rep").alias("a"), F.col("head").alias("b"))
    votes = votes.agg(F.count("*").alias("votes"))
    if tried is not None:
        votes = votes.join(tried, ["a", "b"], "left_anti")
    best = votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("best"))
    return cut_lineage(open_lists.sparkSession, best.select("a", "best.b"), "pairs-with-heads")


def pairs_across(open_lists: DataFrame) -> DataFrame:
    """The different pairs (a, b) of sets in different components that share a list, if their sizes allow a link.

    Near copies share many lists. Of the long ones a pair comes from the longest alone, unless that is
    not among the ``FIRST`` longest of both.
    """
    spark = open_lists.sparkSession
    across = (
        "x.rep > y.rep AND x.component <> y.component"
        " AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)"
    )
    few = open_lists.where(F.col("sets") <= LONG).select("signature", "rep", "n", "component")
    few = few.alias("x").join(few.alias("y"), "signature").where(across)
    own = F.array_sort(F.collect_list(F.struct((-F.col("sets")).alias("sets"), "signature"))).alias("own")
    many = open_lists.where(F.col("sets") > LONG).groupBy("rep", "n", "component").agg(own)
    many = many.select("rep", "n", "component", "own", F.posexplode("own").alias("at", "list")).select(
        F.col("list.signature").alias("signature"), "rep", "n", "component",
        F.expr(f"transform(slice(own, 1, least(at, {FIRST})), o -> o.signature)").alias("before"),
    )
    many = cut_lineage(spark, many, "long-lists")
    first = many.alias("x").join(many.alias("y"), "signature").where(f"{across} AND NOT arrays_overlap(x.before, y.before)")
    a, b = F.col("x.rep").alias("a"), F.col("y.rep").alias("b")
    pairs = cut_lineage(spark, few.select(a, b).unionByName(first.select(a, b)).distinct(), "open-pairs")
    release(many)
    return pairs


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of each row of ``docs``."""
    spark = docs.sparkSession
    sets = token_sets(docs).withColumn("rep", F.xxhash64("s1", "s2", "n")).drop("s1", "s2")
    sets = cut_lineage(spark, sets, "token-sets")
    slim = cut_lineage(spark, sets.select("doc_id", "text_key", "n", "rep"), "named-sets")
    # One document of each set; which one, small rows tell.
    least = slim.where("n > 0 AND doc_id IS NOT NULL").groupBy("rep").agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    least = least.select("rep", "least.doc_id", "least.text_key")
    reps = sets.join(least, ["rep", "doc_id", "text_key"], "left_semi").dropDuplicates(["rep", "doc_id", "text_key"])
    reps = cut_lineage(spark, reps.select("rep", "doc_id", "text_key", "bits", "n", "prefix", "ahead"), "distinct-sets")
    release(sets)
    listed = signatures(docs, reps)
    sizes = listed.groupBy("signature").agg(F.count("*").alias("sets")).where("sets > 1")
    sizes = cut_lineage(spark, sizes, "posting-sizes")
    shared = cut_lineage(spark, listed.join(sizes, "signature"), "postings")
    release(listed, sizes)
    weights = shared.groupBy("rep").agg(F.sum("sets").alias("weight"))
    placed = shared.join(weights, "rep").select("signature", "rep", "n", "sets", "weight", F.col("rep").alias("component"))
    placed = cut_lineage(spark, placed, "placed-postings")
    release(shared)
    links = cut_lineage(spark, sets_of_one_id(slim), "links-of-ids")
    tried, written = None, []
    for number in range(ROUNDS):
        open_lists = lists_across(placed)
        pairs = pairs_with_heads(open_lists if number == 0 else open_lists.where(F.col("sets") > LONG), tried)
        written.append(pairs)
        if number and pairs.isEmpty():
            break
        found = verified(pairs, reps, docs)
        links = links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if number and found.isEmpty():
            break
        grouped = cut_lineage(spark, connected_components(links), "components")
        placed = open_lists.drop("component", "head", "head_component").join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
        placed = cut_lineage(spark, placed.withColumn("component", F.coalesce("component", "rep")), "placed-postings")
        release(open_lists, grouped)
    else:
        open_lists = lists_across(placed)
    rest = pairs_across(open_lists)
    release(open_lists, *written)
    more = verified(rest, reps, docs)
    release(rest, reps)
    grouped = cut_lineage(spark, connected_components(links.unionByName(more)), "components")
    # A set without links is its own component.
    placed = slim.alias("s").join(grouped.withColumnRenamed("node", "rep").alias("g"), "rep", "left").select(
        "doc_id", "text_key", "n", F.coalesce("component", "rep").alias("component")
    )
    placed = cut_lineage(spark, placed, "placed-sets")
    least = placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    least = cut_lineage(spark, least, "component-names")
    none = F.col("n") == 0
    return placed.join(least, "component", "left").select(
        "doc_id", "text_key", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(none, F.col("doc_id")).otherwise(F.col("least"))).alias("component_id"),
    )
