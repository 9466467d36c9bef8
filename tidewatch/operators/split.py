"""Blocks of consecutive rows, and splits that draw whole blocks.

A split or client assignment is fitted once as a few cutoff draws per class. Applying it is a
map-side comparison, so the rows are not shuffled to learn which side they belong to.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.draws import draw
from tidewatch.operators.ordering import (
    CHUNK_BITS,
    bounded_table,
    by_position,
    draw_cutoffs,
    null_safe_join,
    running_count,
    sliding,
    with_halo,
)

# Fixed value: the inner split of the training blocks draws with the outer seed plus this.
INNER_SEED_OFFSET = 9973


def _check_size(block_size: int) -> None:
    if block_size <= 0:
        raise ValueError(f"block_size must be positive, got {block_size}")


def make_blocks(
    df: DataFrame, label: str, pos: str, block_size: int, bits: int = CHUNK_BITS
) -> DataFrame:
    """Add ``block_id`` to rows with a dense ``pos``, whatever order the labels come in.

    Positions that leave a gap or come twice fail the job.

    A block ends where the label changes or after ``block_size`` rows. Within a chunk, blocks are
    counted from the first run that starts there. The rows before it continue a run of an earlier
    chunk; as positions are dense, the blocks they open follow from where that run started.
    """
    _check_size(block_size)
    order = sliding([], pos)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.col(pos)
    continues = F.coalesce(F.lag(label).over(order) == F.col(label), F.lit(False))
    rows = (
        with_halo(df, pos, 1, bits)
        .withColumn("__start", F.when(~continues, here))
        .where(~F.col("__halo"))
        .withColumn("__run", F.max("__start").over(upto))
        .withColumn("__opens", F.coalesce((here - F.col("__run")) % block_size == 0, F.lit(False)))
    )

    earlier = Window.orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)

    def blocks_before(at: Column) -> Column:
        """Blocks the carried run has opened at positions below ``at``."""
        return F.ceil((at - F.col("__carried")) / block_size)

    ordered = Window.orderBy("__chunk")
    dense = (F.col("__last") - F.col("__first") + 1 == F.col("__n")) & F.coalesce(
        F.lag("__last").over(ordered) + 1 == F.col("__first"), F.lit(True)
    )
    sparse = F.raise_error(F.concat(F.lit(f"{pos} is not dense at "), F.col("__first").cast("string")))
    # One row per chunk of 2**bits rows.
    chunks = (
        rows.groupBy("__chunk")
        .agg(
            F.count(F.lit(1)).alias("__n"),
            F.max(pos).alias("__last"),
            F.min(pos).alias("__first"),
            F.coalesce(F.min("__start"), F.max(pos) + 1).alias("__lead_end"),
            F.max("__start").alias("__last_start"),
            F.count_if("__opens").alias("__own"),
        )
        .withColumn("__carried", F.max("__last_start").over(earlier))
        .withColumn(
            "__lead",
            F.coalesce(
                blocks_before(F.col("__lead_end")) - blocks_before(F.col("__first")), F.lit(0)
            ),
        )
        .withColumn(
            "__offset", F.coalesce(F.sum(F.col("__lead") + F.col("__own")).over(earlier), F.lit(0))
        )
        .withColumn("__offset", F.when(dense, F.col("__offset")).otherwise(sparse.cast("long")))
        .select("__chunk", "__first", "__carried", "__lead", "__offset")
    )
    counted = rows.withColumn("__opened", F.count_if("__opens").over(upto))
    in_lead = blocks_before(here + 1) - blocks_before(F.col("__first"))
    opened = F.when(F.col("__run").isNull(), in_lead).otherwise(
        F.col("__lead") + F.col("__opened")
    )
    return counted.join(chunks, "__chunk").select(
        *df.columns, (F.col("__offset") + opened - 1).alias("block_id")
    )


def pooled_blocks(
    df: DataFrame, label: str, order: str, block_size: int, bits: int = CHUNK_BITS
) -> DataFrame:
    """``pos`` and ``block_id`` of rows pooled class by class, in one pass.

    With the classes back to back each class is one run, so a block follows from the row's rank
    within its class; equal to :func:`make_blocks` on the pooled order.
    """
    _check_size(block_size)
    ranked = by_position(df, [label], order, {"__rank": running_count(inclusive=False)}, bits)
    # One row per class: the window below runs over the class list only.
    earlier = Window.orderBy(label).rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    offsets = bounded_table(
        sizes.select(
            label,
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__rows_before"),
            F.coalesce(
                F.sum(F.ceil(F.col("__n") / block_size)).over(earlier), F.lit(0)
            ).alias("__blocks_before"),
        )
    )
    return null_safe_join(ranked, offsets, [label]).select(
        *df.columns,
        (F.col("__rows_before") + F.col("__rank")).alias("pos"),
        (F.col("__blocks_before") + F.floor(F.col("__rank") / block_size)).alias("block_id"),
    )


def block_labels(df: DataFrame, label: str) -> DataFrame:
    """One row per block with its label and size; a block with two labels fails the job."""
    mixed = F.raise_error(
        F.concat(F.lit("block spans more than one label: "), F.col("block_id").cast("string"))
    )
    return (
        df.groupBy("block_id")
        .agg(
            F.min(label).alias("__low"),
            F.max(label).alias("__high"),
            F.count(F.lit(1)).alias("n_rows"),
        )
        .select(
            "block_id",
            F.when(F.col("__low") == F.col("__high"), F.col("__low"))
            .otherwise(mixed.cast(df.schema[label].dataType))
            .alias(label),
            "n_rows",
        )
    )


def fit_block_split(blocks: DataFrame, label: str, fraction: float, seed: int) -> DataFrame:
    """Cutoff draws, one row per class, that put ``fraction`` of its blocks on the test side."""
    if not 0.0 < fraction < 1.0:
        raise ValueError(f"test fraction must be in (0, 1), got {fraction}")
    return _block_cutoffs(
        blocks, label, seed, lambda n: F.array(F.bround(n * fraction).cast("long"))
    )


def _block_cutoffs(blocks: DataFrame, label: str, seed: int, ranks) -> DataFrame:
    """:func:`draw_cutoffs` over blocks. The block list is a block size shorter than the rows, so
    it is kept for the two passes rather than derived from the rows twice."""
    kept = blocks.select(label, "block_id").persist()
    try:
        return draw_cutoffs(kept, [label], draw(seed, label, "block_id"), ranks)
    finally:
        kept.unpersist()


def _with_cutoffs(df: DataFrame, cutoffs: DataFrame, label: str) -> DataFrame:
    """Rows with their class's cutoffs; a row of a class without any, or of none, fails the job."""
    stray = F.raise_error(
        F.concat(F.lit("no cutoffs for the label "), F.coalesce(F.col(label).cast("string"), F.lit("null")))
    )
    known = F.col(label).isNotNull() & F.col("cutoffs").isNotNull()
    return df.join(cutoffs, label, "left").withColumn(
        "cutoffs", F.when(known, F.col("cutoffs")).otherwise(stray.cast("array<string>"))
    )


def assign_side(df: DataFrame, cutoffs: DataFrame, label: str, seed: int) -> DataFrame:
    """Add ``side`` ('test' or 'train') to blocks or to rows that carry a block id."""
    chosen = draw(seed, label, "block_id") <= F.col("cutoffs")[0]
    return (
        _with_cutoffs(df, cutoffs, label)
        .withColumn("side", F.when(chosen, F.lit("test")).otherwise(F.lit("train")))
        .select(*df.columns, "side")
    )


def stratified_block_split(
    df: DataFrame, label: str, fraction: float, seed: int
) -> DataFrame:
    """Rows with ``block_id`` and ``label`` in, the same rows with ``side`` out."""
    cutoffs = fit_block_split(block_labels(df, label), label, fraction, seed)
    return assign_side(df, cutoffs, label, seed)


def inner_split(train: DataFrame, label: str, fraction: float, seed: int) -> DataFrame:
    """The nested validation split of training blocks; ``side`` is 'test' for validation."""
    inner_seed = seed + INNER_SEED_OFFSET
    blocks = block_labels(train, label)
    cutoffs = fit_block_split(blocks, label, fraction, inner_seed)
    sides = {r["side"] for r in assign_side(blocks, cutoffs, label, inner_seed)
             .select("side").distinct().collect()}
    if sides != {"train", "test"}:
        raise ValueError("the inner split left one side empty")
    return assign_side(train, cutoffs, label, inner_seed)


def keep_blocks(df: DataFrame, block_ids: DataFrame) -> DataFrame:
    """The rows of the given blocks. Blocks are short, so the join key is never hot."""
    return df.join(block_ids.select("block_id").distinct(), "block_id", "left_semi")


# --- client partition -------------------------------------------------------------------------


def dirichlet_cuts(
    labels: list[str], n_clients: int, alpha: float, seed: int
) -> dict[str, list[float]]:
    """Per class, the cumulative client shares of a fresh Dirichlet draw (the last is implied)."""
    if n_clients <= 0:
        raise ValueError(f"n_clients must be positive, got {n_clients}")
    if alpha <= 0:
        raise ValueError(f"alpha must be positive, got {alpha}")
    rng = np.random.default_rng(seed)
    return {
        label: np.cumsum(rng.dirichlet(np.full(n_clients, alpha)))[:-1].tolist()
        for label in sorted(labels, key=str)
    }


def _class_list(df: DataFrame, label: str, max_classes: int = 10_000) -> list[str]:
    found = [r[0] for r in df.select(label).distinct().limit(max_classes + 1).collect()]
    if len(found) > max_classes:
        raise ValueError(f"more than {max_classes} classes in {label}")
    return sorted(found, key=str)


def fit_clients(
    blocks: DataFrame, label: str, n_clients: int, alpha: float, seed: int
) -> DataFrame:
    """Cutoff draws, one row per class, that cut its blocks into client shares."""
    blocks = blocks.select(label, "block_id").persist()
    try:
        return _client_cutoffs(blocks, label, n_clients, alpha, seed)
    finally:
        blocks.unpersist()


def _client_cutoffs(
    blocks: DataFrame, label: str, n_clients: int, alpha: float, seed: int
) -> DataFrame:
    cuts = dirichlet_cuts(_class_list(blocks, label), n_clients, alpha, seed)
    if n_clients == 1:
        return bounded_table(
            blocks.select(label).distinct().withColumn("cutoffs", F.array().cast("array<string>"))
        )
    pairs = []
    for name, shares in cuts.items():
        pairs += [F.lit(name), F.array(*[F.lit(s) for s in shares])]
    shares_of = F.create_map(*pairs)
    return draw_cutoffs(
        blocks,
        [label],
        draw(seed, label, "block_id"),
        lambda n: F.transform(
            F.element_at(shares_of, F.col(label)), lambda share: F.floor(share * n)
        ),
    )


def assign_clients(df: DataFrame, cutoffs: DataFrame, label: str, seed: int) -> DataFrame:
    """Add ``client_id`` to blocks or to rows: how many cuts the block's draw lies beyond."""
    order = draw(seed, label, "block_id")
    client = F.size(F.filter("cutoffs", lambda cut: order > cut))
    return _with_cutoffs(df, cutoffs, label).withColumn("client_id", client).select(
        *df.columns, "client_id"
    )


def client_histogram(assigned: DataFrame, label: str, n_clients: int) -> DataFrame:
    """Blocks per client and class, zeros kept for absent classes and empty clients."""
    grid = assigned.select(label).distinct().select(
        label, F.explode(F.sequence(F.lit(0), F.lit(n_clients - 1))).alias("client_id")
    )
    counts = assigned.groupBy("client_id", label).agg(F.count(F.lit(1)).alias("__n"))
    return grid.join(counts, ["client_id", label], "left").select(
        "client_id", label, F.coalesce("__n", F.lit(0)).alias("n_blocks")
    )


def require_known_blocks(block_ids: DataFrame, blocks: DataFrame) -> None:
    """Fail when an assignment names a block outside the corpus."""
    stray = block_ids.join(blocks.select("block_id"), "block_id", "left_anti").first()
    if stray is not None:
        raise ValueError(f"block id {stray['block_id']} is outside the corpus")
