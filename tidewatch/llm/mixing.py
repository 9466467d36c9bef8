"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Of all ways to repeat documents so that each source gives its target number of words, the one
closest to the corpus in relative entropy (documents weighed by their words) tilts each document's
rate exponentially: rate = exp(lambda of its source). The multipliers minimise the convex dual

    sum over documents of size * exp(lambda) - sum over sources of lambda * target

and Newton's steps on it need, for each source, the mass under the present rates: one aggregate
over the (source, size) histogram a step. Rates are then rounded into whole copies, systematically
in order of falling size, so that a source's rounding error is at most about one document. Then
documents are added, taken back or swapped as long as that brings a source nearer its target, so in
the end no single move and no swap of two documents would.

Defined results: null texts have size 0. Documents without words are taken 0 words. Null is a
source like others, ordered last. A table without words gives targets 0. Rows that are the same
are rounded like any others; no document is taken more than twice. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD
from tidewatch.session import cut_lineage

#: The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A size held by more documents than this is dealt into cells of about so many.
CELL = 256


def document_sizes(docs: DataFrame) -> DataFrame:
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.col("source").cast("string").alias("source"),
        words.cast("long").alias("size"),
    )


def source_targets(
    totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size) with ``target``: shares by weight of ``share`` times all words, none
    above ``most`` times its source, the excess shared again.

    Sources in order of cap over weight: the first ones are capped, up to the first whose share of
    what the capped ones leave is below its cap. One row per source goes through these windows.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = totals.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    rows = ranked.select(
        "source",
        "source_size",
        "place",
        weight.alias("weight"),
        (F.lit(most) * F.col("source_size")).alias("cap"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("budget"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    free = F.col("cap") > F.col("level") * F.col("weight")
    first_free = F.min(F.when(free, F.struct(F.col("cap") / F.col("weight"), F.col("place"), F.col("level")))).over(everything)
    rows = rows.withColumn("first_free", first_free)
    return rows.select(
        "source",
        "source_size",
        F.when(F.col("first_free").isNull(), F.col("cap"))
        .otherwise(F.least(F.col("cap"), F.col("first_free.level") * F.col("weight")))
        .alias("target"),
    )


def balance(histogram: DataFrame, targets: DataFrame, tolerance: float = 1e-10, steps: int = 60) -> DataFrame:
    """(source, source_size, target, rate): Newton on the dual, from rate 1.

    ``histogram`` has (source, size, n). Sources without words or with target 0 get rate 0.
    """
    spark = histogram.sparkSession
    state = cut_lineage(spark, targets.withColumn("tilt", F.lit(0.0)), "mix-tilts")
    live = (F.col("target") > 0) & (F.col("source_size") > 0)
    for _ in range(steps):
        mass = (
            histogram.alias("h")
            .join(state.where(live).alias("s"), F.col("h.source").eqNullSafe(F.col("s.source")))
            .groupBy("s.source")
            .agg(F.sum(F.col("n") * F.col("size") * F.exp("tilt")).alias("mass"))
        )
        slope = F.col("mass") - F.col("target")
        stepped = state.alias("s").join(mass.alias("m"), F.col("s.source").eqNullSafe(F.col("m.source")), "left").select(
            "s.source",
            "source_size",
            "target",
            # The second derivative is the mass itself.
            F.when(live, F.col("tilt") - slope / F.col("mass")).otherwise(F.lit(0.0)).alias("tilt"),
            F.when(live, F.abs(slope) / F.col("target")).otherwise(F.lit(0.0)).alias("error"),
        )
        written = cut_lineage(spark, stepped, "mix-tilts")
        state = written.drop("error")
        # One number for all sources.
        worst = written.agg(F.max("error")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError("the dual of the mixing weights did not converge")
    rate = F.when(live, F.exp("tilt")).otherwise(F.lit(0.0))
    whole = F.round(rate)
    return state.select(
        "source", "source_size", "target", F.when(F.abs(rate - whole) < 1e-9, whole).otherwise(rate).alias("rate")
    )


def round_rates(sizes: DataFrame, histogram: DataFrame, rates: DataFrame) -> DataFrame:
    """Sizes with ``copies``: the whole part of the rate, and one more for evenly spread documents.

    Documents are laid out by falling size. Documents of one size are alike, so any of them may be
    taken; a size of many documents is dealt into cells by hash. Only the cells, not the documents,
    are accumulated by source.
    """
    dealt = histogram.select(
        "source", "size", F.ceil(F.col("n") / F.lit(float(CELL))).cast("int").alias("cells")
    )
    celled = (
        sizes.alias("d")
        .join(dealt.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.size") == F.col("c.size")))
        .select(
            "doc_id", "text_key", "d.source", "d.size",
            F.pmod(F.xxhash64("doc_id", "text_key"), F.col("cells")).cast("int").alias("cell"),
        )
    )
    celled = cut_lineage(sizes.sparkSession, celled, "mix-cells")
    by_size = Window.partitionBy("source").orderBy(F.desc("size"), "cell")
    offsets = (
        celled.where("size > 0")
        .groupBy("source", "size", "cell")
        .agg(F.count("*").alias("n"))
        .select("source", "size", "cell", (F.sum("n").over(by_size) - F.col("n")).alias("offset"))
    )
    in_cell = Window.partitionBy("source", "size", "cell").orderBy("doc_id", "text_key")
    ranked = celled.where("size > 0").withColumn("rank", F.row_number().over(in_cell))
    part = F.col("rate") - F.floor("rate")
    place = F.col("offset") + F.col("rank")
    extra = F.floor(place * part + 0.5) - F.floor((place - 1) * part + 0.5)
    placed = (
        ranked.alias("d")
        .join(
            offsets.alias("o"),
            F.col("d.source").eqNullSafe(F.col("o.source"))
            & (F.col("d.size") == F.col("o.size"))
            & (F.col("d.cell") == F.col("o.cell")),
        )
        .join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
        .select(
            "doc_id", "text_key", "d.source", "d.size", "source_size", "target",
            (F.floor("rate") + extra).cast("int").alias("copies"),
        )
    )
    empty = (
        celled.where("size = 0").alias("d")
        .join(rates.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source")))
        .select(
            "doc_id", "text_key", "d.source", "d.size", "source_size", "target",
            F.floor("rate").cast("int").alias("copies"),
        )
    )
    return placed.unionByName(empty)


def best_moves(counts: DataFrame, gaps: DataFrame) -> DataFrame:
    """(source, up, down): the documents to add and to take back that bring each source nearest its target.

    ``counts`` has (source, size, copies, n). ``up`` and ``down`` are (size, copies), size 0 for none.
    For each document to take back, the nearest sizes to add lie next to gap + size in order of size.
    Only sources that come nearer are returned.
    """
    none = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("copies"))
    whole = gaps.where(F.abs("gap") > 1e-6)
    up = counts.where("copies < 2").groupBy("source", "size").agg(F.min("copies").alias("copies"))
    up = up.select("source", F.struct("size", "copies").alias("up")).unionByName(whole.select("source", none.alias("up")))
    down = counts.where("copies > 0").groupBy("source", "size").agg(F.max("copies").alias("copies"))
    down = down.select("source", F.struct("size", "copies").alias("down")).unionByName(whole.select("source", none.alias("down")))
    same = F.col("a.source").eqNullSafe(F.col("g.source"))
    asked = down.alias("a").join(whole.alias("g"), same).select(
        "a.source", (F.col("gap") + F.col("down.size")).alias("key"), "gap", "down", F.lit(None).cast("struct<size:long,copies:int>").alias("up")
    )
    given = up.alias("a").join(whole.alias("g"), same).select(
        "a.source", F.col("up.size").cast("double").alias("key"), "gap", F.lit(None).cast("struct<size:long,copies:int>").alias("down"), "up"
    )
    rows = asked.unionByName(given)
    by = Window.partitionBy("source")
    below = F.last("up", ignorenulls=True).over(by.orderBy("key", F.col("up").isNull()))
    above = F.last("up", ignorenulls=True).over(by.orderBy(F.desc("key"), F.col("up").isNull()))
    pairs = rows.select("source", "gap", "down", F.array(below.alias("up"), above.alias("up")).alias("near")).where("down IS NOT NULL")
    pairs = pairs.select("source", "gap", "down", F.explode("near").alias("up")).where("up IS NOT NULL")
    left = F.abs(F.col("gap") - F.col("up.size") + F.col("down.size"))
    best = pairs.groupBy("source").agg(
        F.min(F.struct(left.alias("left"), F.col("up"), F.col("down"))).alias("best"), F.abs(F.first("gap")).alias("now")
    )
    return best.where(F.col("best.left") < F.col("now") - 1e-6).select("source", "best.up", "best.down")


def close_gaps(rounded: DataFrame) -> DataFrame:
    """Add a document, take one back, or both, as long as that brings a source nearer its target.

    At the end no single move and no swap of two documents helps. The moves are found on the histogram
    of (source, size, copies); documents are touched once, by the moves' sum.
    """
    spark = rounded.sparkSession
    cells = ["source", "size", "copies"]
    before = rounded.where("size > 0").groupBy(*cells).agg(F.count("*").cast("long").alias("n"))
    before = cut_lineage(spark, before, "mix-counts")
    targets = cut_lineage(spark, rounded.groupBy("source").agg(F.first("target").alias("target")), "mix-targets")
    counts, steps = before, 0
    while True:
        taken = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("copies") * F.col("n")).alias("words"))
        gaps = targets.alias("t").join(taken.alias("w"), F.col("t.source").eqNullSafe(F.col("w.source")), "left").select(
            "t.source", (F.col("target") - F.coalesce("words", F.lit(0))).alias("gap")
        )
        moves = cut_lineage(spark, best_moves(counts, gaps), "mix-moves")
        if moves.isEmpty():
            break
        steps += 1
        changes = F.inline(F.array(*[
            F.struct(F.col(f"{side}.size").alias("size"), (F.col(f"{side}.copies") + moved).cast("int").alias("copies"), F.lit(n).cast("long").alias("n"))
            for side, way in (("up", 1), ("down", -1)) for moved, n in ((0, -1), (way, 1))
        ]))
        changed = counts.unionByName(moves.select("source", changes).where("size > 0"))
        counts = cut_lineage(spark, changed.groupBy(*cells).agg(F.sum("n").alias("n")).where("n > 0"), "mix-counts")
    if not steps:
        return rounded
    # Of each size, how many more documents have 0, 1 and 2 copies now.
    more = before.select("source", "size", "copies", (-F.col("n")).alias("n")).unionByName(counts)
    more = more.groupBy("source", "size").agg(
        *[F.sum(F.when(F.col("copies") == c, F.col("n")).otherwise(0)).alias(f"more_{c}") for c in (0, 1, 2)]
    ).where("more_0 <> 0 OR more_1 <> 0 OR more_2 <> 0")
    same = F.col("d.source").eqNullSafe(F.col("m.source")) & (F.col("d.size") == F.col("m.size"))
    draw = [F.xxhash64("doc_id", "text_key"), F.col("doc_id"), F.col("text_key")]
    # A step touches two documents of a source, so so many of each cell are enough to choose from.
    in_cell = Window.partitionBy("source", "size", "copies").orderBy(*draw)
    chosen = rounded.alias("d").join(more.alias("m"), same).select("d.*", "more_0", "more_1", "more_2").withColumn(
        "rank", F.row_number().over(in_cell)
    ).where(F.col("rank") <= 2 * steps)
    in_size = Window.partitionBy("source", "size")
    have = [F.sum((F.col("copies") == c).cast("long")).over(in_size) + F.col(f"more_{c}") for c in (0, 1)]
    placed = chosen.withColumns({"none": have[0], "once": have[0] + have[1]}).withColumn(
        "place", F.row_number().over(in_size.orderBy("copies", *draw))
    )
    now = F.when(F.col("place") <= F.col("none"), 0).when(F.col("place") <= F.col("once"), 1).otherwise(2)
    moved = placed.withColumn("now", now).where("now <> copies").groupBy("doc_id", "text_key", "source", "size", "copies", "now").agg(
        F.count("*").alias("rows")
    )
    moved = cut_lineage(spark, moved, "mix-moved")
    # Rows that are the same are told apart by a number among themselves.
    key = ["doc_id", "text_key", "source", "size", "copies"]
    touched = F.lit(True)
    for name in key:
        touched = touched & F.col(f"d.{name}").eqNullSafe(F.col(f"m.{name}"))
    named = moved.groupBy(*key).agg(F.array_sort(F.flatten(F.collect_list(F.expr("array_repeat(now, cast(rows AS int))")))).alias("to"))
    both = rounded.alias("d").join(named.alias("m"), touched, "left").select("d.*", "to")
    plain = both.where("to IS NULL").drop("to")
    equal = Window.partitionBy(*key).orderBy("target")
    several = both.where("to IS NOT NULL").withColumn("nth", F.row_number().over(equal))
    several = several.withColumn("copies", F.coalesce(F.get("to", F.col("nth") - 1), F.col("copies"))).drop("to", "nth")
    return plain.unionByName(several)


def mix_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, copies) of each row of ``docs``."""
    spark = docs.sparkSession
    sizes = cut_lineage(spark, document_sizes(docs), "mix-sizes")
    histogram = cut_lineage(
        spark, sizes.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram"
    )
    totals = histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    rates = balance(histogram, source_targets(totals))
    rounded = cut_lineage(spark, round_rates(sizes, histogram, rates), "mix-copies")
    return close_gaps(rounded)


def taken(column: str = "copies") -> Column:
    return (F.col(column) * F.col("size")).cast("long")
