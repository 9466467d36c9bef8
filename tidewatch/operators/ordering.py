"""Order-dependent work without a task that holds a whole key.

A Spark window sorts one partition key in one task. A source or class may hold a third of all
rows here, so nothing below lets a window span a key. Rows are grouped by (key, chunk), where a
chunk is a bounded stretch of the order, and the chunks are linked in one of two ways:

* :func:`running` - a small table with one row per (long key, chunk) carries counts, sums, maxima or
  the last value over to the later chunks. Keys that fit a chunk need none of it.
* :func:`with_halo` - a frame of fixed width only needs the few rows before the chunk, so those
  rows are copied into the next chunk and nothing is joined.

:func:`draw_cutoffs` finds order statistics of random draws from a histogram of their prefixes,
so that "the first n of each class in random order" costs no shuffle of the rows. :func:`at_ranks`
does the same for numbers, and :func:`in_order` numbers rows by any order, so that the running
results above apply to it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut_lineage

# A chunk spans 2**18 positions; positions are unique, so it holds at most that many rows.
CHUNK_BITS = 18
# Draws are hex strings; four digits split them into 65,536 buckets of equal expected size.
DRAW_PREFIX = 4
# What a broadcast table may hold.
BOUNDED_ROWS = 100_000
BOUNDED_BYTES = 32 << 20
# A monotonically increasing id holds the partition above these bits, and the row below.
PLACE_BITS = 33
# Radix selection reads 16 bits of a value at a time.
RADIX_SHIFTS = (48, 32, 16, 0)


def position_chunk(pos: Column | str, bits: int = CHUNK_BITS) -> Column:
    """The chunk of a unique integer position."""
    column = F.col(pos) if isinstance(pos, str) else pos
    return F.shiftright(column.cast("long"), bits)


def bounded_table(df: DataFrame, max_rows: int = BOUNDED_ROWS) -> DataFrame:
    """``df`` as a broadcast local table when it has at most ``max_rows`` rows and ``BOUNDED_BYTES``,
    else ``df`` as is.

    For tables whose size follows the class domain, the feature list or the client list. Beyond
    the bound the unhinted table goes on to a shuffle join.
    """
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows or table.nbytes > BOUNDED_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, df.schema))


@dataclass(frozen=True)
class Running:
    """One running result; build with the helpers below."""

    kind: str
    value: Column | None = None
    inclusive: bool = True


def running_count(inclusive: bool = True) -> Running:
    return Running("count", None, inclusive)


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def previous(value: Column) -> Running:
    """The value of the row before, null on the first row of the key."""
    return Running("previous", value, False)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    chunk: Sequence[Column],
    outputs: dict[str, Running],
    long_rows: int = 1 << CHUNK_BITS,
) -> DataFrame:
    """Add running results per ``keys`` in ``order``.

    ``chunk`` must be monotone in ``order`` within a key and bound the rows of one (key, chunk).
    ``order`` must be unique within a key.

    Keys are counted first. Those of at most ``long_rows`` rows get a plain window; only longer ones,
    of which there are at most rows / ``long_rows``, are cut into chunks that are linked.
    """
    keys = list(keys)
    if not keys:
        return _linked(df, df, keys, order, chunk, outputs)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > long_rows)
    found = sizes.select(*keys).limit(BOUNDED_ROWS + 1).toArrow()
    if not found.num_rows:
        return _windowed(df, keys, order, outputs)
    long = sizes.select(*keys)
    if found.num_rows <= BOUNDED_ROWS and found.nbytes <= BOUNDED_BYTES:
        long = F.broadcast(df.sparkSession.createDataFrame(found, long.schema))
    marked = null_safe_join(df, long.withColumn("__long", F.lit(True)), keys, "left")
    chunk = [F.when(F.col("__long"), c) for c in chunk]
    nulls = found.num_rows > BOUNDED_ROWS or any(found[k].null_count for k in keys)
    linked = _linked(marked, marked.where("__long"), keys, order, chunk, outputs, nulls)
    return linked.drop("__long")


def _local_values(outputs: dict[str, Running], local) -> list[Column]:
    """The running results within the window ``local``."""
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    values = []
    for spec in outputs.values():
        frame = upto if spec.inclusive else before
        if spec.kind == "count":
            count = F.row_number().over(local).cast("long")
            values.append(count if spec.inclusive else count - 1)
        elif spec.kind == "sum":
            values.append(F.coalesce(F.sum(spec.value).over(frame), F.lit(0)))
        elif spec.kind == "max":
            values.append(F.max(spec.value).over(frame))
        else:
            values.append(F.lag(F.struct(spec.value.alias("v"))).over(local))
    return values


def _windowed(df: DataFrame, keys: list[str], order: Sequence[Column], outputs: dict[str, Running]) -> DataFrame:
    values = _local_values(outputs, Window.partitionBy(*keys).orderBy(*order))
    named = [
        (value["v"] if spec.kind == "previous" else value).alias(name)
        for value, (name, spec) in zip(values, outputs.items(), strict=True)
    ]
    kept = [c for c in df.columns if c not in outputs]
    return df.select(*kept, *named)


def _linked(
    df: DataFrame,
    long: DataFrame,
    keys: list[str],
    order: Sequence[Column],
    chunk: Sequence[Column],
    outputs: dict[str, Running],
    nulls: bool = False,
) -> DataFrame:
    """Results within each (key, chunk), and what the chunks of ``long`` carry over to later ones.

    ``nulls``: if null may be a key of ``long``, which costs the join the partitioning the rows have.
    """
    chunk_names = [f"__chunk_{i}" for i in range(len(chunk))]
    chunks = [c.alias(n) for c, n in zip(chunk, chunk_names, strict=True)]
    rank_of = order[0] if len(order) == 1 else F.struct(*order)
    by_chunk = Window.partitionBy(*keys).orderBy(*chunk_names)
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)

    totals, carried, combined = [], [], []
    for index, (name, spec) in enumerate(outputs.items()):
        here, total, carry = f"__here_{index}", f"__total_{index}", f"__carry_{index}"
        if spec.kind in ("count", "sum"):
            totals.append((F.count(F.lit(1)) if spec.kind == "count" else F.sum(spec.value)).alias(total))
            carried.append(F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(carry))
            combined.append((F.col(here) + F.coalesce(carry, F.lit(0))).alias(name))
        elif spec.kind == "max":
            totals.append(F.max(spec.value).alias(total))
            carried.append(F.max(total).over(earlier).alias(carry))
            combined.append(F.greatest(here, carry).alias(name))
        else:
            boxed = F.struct(spec.value.alias("v"))
            totals.append(F.max_by(boxed, rank_of).alias(total))
            carried.append(F.lag(total).over(by_chunk).alias(carry))
            combined.append(F.coalesce(here, carry)["v"].alias(name))

    local = Window.partitionBy(*keys, *chunk_names).orderBy(*order)
    values = [v.alias(f"__here_{i}") for i, v in enumerate(_local_values(outputs, local))]
    rows = df.select("*", *chunks).select("*", *values)
    carry_table = (
        long.groupBy(*[F.col(k) for k in keys], *chunks)
        .agg(*totals)
        .select(*keys, *chunk_names, *carried)
    )
    kept = [c for c in df.columns if c not in outputs]
    # A chunk's number is part of the key, so short keys, which have none, meet nothing.
    renamed = carry_table.withColumnsRenamed({c: f"__of_{c}" for c in [*keys, *chunk_names]})
    same = F.lit(True)
    for name in [*keys, *chunk_names]:
        other = F.col(f"__of_{name}")
        same = same & (F.col(name).eqNullSafe(other) if nulls and name in keys else F.col(name) == other)
    return rows.join(renamed, same, "left").select(*kept, *combined)


def by_position(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    outputs: dict[str, Running],
    bits: int = CHUNK_BITS,
) -> DataFrame:
    """:func:`running` over a unique integer position."""
    return running(df, keys, [F.col(pos)], [position_chunk(pos, bits)], outputs, 1 << bits)


def with_halo(df: DataFrame, pos: str, before: int, bits: int = CHUNK_BITS) -> DataFrame:
    """Add ``__chunk`` and copy the last ``before`` positions of each chunk into the next.

    Copies carry ``__halo = true`` and are dropped once the frame has been read.
    """
    size = 1 << bits
    if not 0 <= before < size:
        raise ValueError(f"a halo of {before} rows does not fit a chunk of {size}")
    own = F.struct(position_chunk(pos, bits).alias("__chunk"), F.lit(False).alias("__halo"))
    if before == 0:
        return df.select("*", own["__chunk"].alias("__chunk"), F.lit(False).alias("__halo"))
    copy = F.struct(
        (position_chunk(pos, bits) + 1).alias("__chunk"), F.lit(True).alias("__halo")
    )
    near_end = F.pmod(F.col(pos), F.lit(size)) >= size - before
    return df.select("*", F.inline(F.when(near_end, F.array(own, copy)).otherwise(F.array(own))))


def sliding(keys: Sequence[str], pos: str):
    """The ordered window over one (key, chunk) of a frame from :func:`with_halo`."""
    return Window.partitionBy(*keys, "__chunk").orderBy(pos)


def draw_cutoffs(
    df: DataFrame,
    keys: Sequence[str],
    draw: Column,
    ranks: Callable[[Column], Column],
    max_keys: int = BOUNDED_ROWS,
) -> DataFrame:
    """Per key, the draws at the 1-based ``ranks(n)`` of its ``n`` draws.

    ``ranks`` maps the row count to an array of ranks and may read the key columns. Returns
    (keys, ``cutoffs``), where a rank of 0 yields the empty string: a row is among the first
    ``rank`` of its key exactly when its draw is not greater than the cutoff.

    The bucket that holds a rank is read off a histogram of draw prefixes; only the rows of that
    one bucket are sorted. Draws must be unique within a key.
    """
    keys = list(keys)
    drawn = df.select(*keys, draw.alias("__draw")).withColumn(
        "__bucket", F.substring("__draw", 1, DRAW_PREFIX)
    )
    per_key = Window.partitionBy(*keys)
    histogram = (
        drawn.groupBy(*keys, "__bucket")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__upto", F.sum("__n").over(per_key.orderBy("__bucket")))
        .withColumn("__rows", F.sum("__n").over(per_key))
    )
    wanted = bounded_table(
        histogram.select(*keys, "__bucket", "__n", "__upto", F.posexplode(ranks(F.col("__rows"))))
        .withColumnsRenamed({"pos": "__slot", "col": "__rank"})
        .where(
            ((F.col("__rank") <= F.col("__upto"))
             & (F.col("__rank") > F.col("__upto") - F.col("__n")))
            | ((F.col("__rank") <= 0) & (F.col("__upto") == F.col("__n")))
        ),
        max_keys,
    )
    inside = Window.partitionBy(*keys, "__bucket", "__slot").orderBy("__draw")
    found = (
        null_safe_join(drawn, wanted, [*keys, "__bucket"])
        .withColumn("__at", F.row_number().over(inside) + F.col("__upto") - F.col("__n"))
        .where(F.col("__at") == F.greatest(F.col("__rank"), F.lit(1)))
        .select(
            *keys,
            "__slot",
            F.when(F.col("__rank") <= 0, F.lit("")).otherwise(F.col("__draw")).alias("__cut"),
        )
    )
    return bounded_table(
        found.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("__slot", "__cut"))).alias("__cuts"))
        .select(*keys, F.col("__cuts")["__cut"].alias("cutoffs")),
        max_keys,
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"):
    """Join on ``keys``, where null meets null."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(renamed[f"__right_{key}"])
    return left.join(renamed, same, how).drop(*[f"__right_{k}" for k in keys])


def in_order(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``at``, the dense 0-based place of each row in ``order``.

    Ranges of the whole order are sorted and numbered apart, then shifted by the sizes of the ranges
    before, so no key has to fit a task. The sorted rows are written once, which fixes the places of
    equal rows.
    """
    place = F.monotonically_increasing_id()
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", place)
    rows = cut_lineage(df.sparkSession, ranges, "in-order")
    part = F.shiftright("__place", PLACE_BITS)
    # One row for each range.
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.col("__place").bitwiseAND((1 << PLACE_BITS) - 1)
    placed = rows.withColumn("__part", part).join(starts, "__part")
    return placed.select(*df.columns, (F.col("__start") + within).alias("at"))


def ordered_image(value: Column) -> Column:
    """A long for each double that keeps its order: the bits of a positive double, their negative
    for a negative one. Both zeros are 0, and NaN is above infinity."""
    x = value.cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size)).cast("double")
    power = lambda e: F.pow(F.lit(2.0), e)
    exponent = F.when(size >= power(guess + 1), guess + 1).when(size < power(guess), guess - 1).otherwise(guess)
    # Products with powers of two are exact, so the mantissa comes out whole.
    mantissa = ((size / power(exponent) - 1) * float(1 << 52)).cast("long")
    normal = (exponent.cast("long") + 1023) * (1 << 52) + mantissa
    small = (size * float(2**537) * float(2**537)).cast("long")
    image = (
        F.when(size == 0, F.lit(0).cast("long"))
        .when(size < 2.0**-1022, small)
        .when(size == float("inf"), F.lit(2047 << 52).cast("long"))
        .otherwise(normal)
    )
    return (
        F.when(x.isNull(), F.lit(None).cast("long"))
        .when(F.isnan(x), F.lit((2047 << 52) + 1).cast("long"))
        .when(x < 0, -image)
        .otherwise(image)
    )


def at_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: dict[str, Callable[[Column], Column]],
    rows_per_bucket: int = 1 << CHUNK_BITS,
) -> DataFrame:
    """Exact order statistics: per key, the values at the 0-based ranks ``ranks[name](n)``.

    Radix selection: a histogram of the upper 16 bits of the values' ordered images tells the bucket
    of each rank, and buckets of more than ``rows_per_bucket`` rows are refined by their next 16
    bits. Only the rows of the last buckets are sorted; equal values are counted before they are
    shuffled. Null values have no rank and do not count.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("__v"), ordered_image(F.col(value)).alias("__bits")
    )
    shift = RADIX_SHIFTS[0]
    counted = rows.groupBy(*keys, F.shiftright("__bits", shift).alias("__bucket")).agg(
        F.count(F.lit(1)).alias("__n")
    )
    per_key = Window.partitionBy(*keys)
    counted = counted.withColumn("n", F.sum("__n").over(per_key))
    slots = F.explode(
        F.array(*[F.struct(F.lit(i).alias("__slot"), rank(F.col("n")).cast("long").alias("__at"))
                  for i, rank in enumerate(ranks.values())])
    )
    asked = counted.withColumn("__upto", F.sum("__n").over(per_key.orderBy("__bucket")))
    wanted = _hit(asked.select("*", slots.alias("__ask")).select("*", "__ask.*"), [*keys, "n", "__slot"])
    for finer in RADIX_SHIFTS[1:]:
        if (wanted.agg(F.max("__n")).first()[0] or 0) <= rows_per_bucket:
            break
        inside = null_safe_join(
            rows.withColumn("__bucket", F.shiftright("__bits", shift)),
            wanted.select(*keys, "__bucket").distinct(), [*keys, "__bucket"],
        )
        parts = inside.groupBy(*keys, "__bucket", F.shiftright("__bits", finer).alias("__part")).agg(
            F.count(F.lit(1)).alias("__n")
        )
        upto = F.sum("__n").over(Window.partitionBy(*keys, "__bucket").orderBy("__part"))
        asked = null_safe_join(
            wanted.drop("__n"), parts.withColumn("__upto", upto), [*keys, "__bucket"]
        ).drop("__bucket").withColumnRenamed("__part", "__bucket")
        wanted, shift = _hit(asked, [*keys, "n", "__slot"]), finer
    inside = null_safe_join(
        rows.withColumn("__bucket", F.shiftright("__bits", shift)),
        wanted.select(*keys, "__bucket").distinct(), [*keys, "__bucket"],
    )
    values = inside.groupBy(*keys, "__bucket", "__v").agg(F.count(F.lit(1)).alias("__same"))
    upto = F.sum("__same").over(Window.partitionBy(*keys, "__bucket").orderBy("__v"))
    found = null_safe_join(
        wanted, values.withColumn("__upto", upto), [*keys, "__bucket"]
    ).where((F.col("__upto") > F.col("__at")) & (F.col("__upto") - F.col("__same") <= F.col("__at")))
    picks = [F.max(F.when(F.col("__slot") == i, F.col("__v"))).alias(name) for i, name in enumerate(ranks)]
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def _hit(asked: DataFrame, kept: list[str]) -> DataFrame:
    """Of each asked rank the bucket that holds it, with the rank within that bucket."""
    start = F.col("__upto") - F.col("__n")
    hits = asked.where((F.col("__upto") > F.col("__at")) & (start <= F.col("__at")))
    return bounded_table(hits.select(*kept, "__bucket", "__n", (F.col("__at") - start).alias("__at")))
