"""Merkle manifest of a dataset by time-forward processing.

Each document is a leaf, each source a tree of runs of ``ARITY`` neighbours, and the sources' subroots
make a tree of their own. A node is labelled by (tree, level, number). Digests travel to the node
they are part of through a priority queue ordered by that label: a node is hashed when its label is
the least in the queue, and its own digest is sent on. Then the queue runs backwards: a node hands
each child the proof that holds for it, the child's siblings before what it has got itself.

The queue is external. Its labels are cut into stretches of ``HEIGHT`` levels and ``ARITY ** HEIGHT``
numbers; Spark's sorted shuffle brings the messages of a stretch together, whatever their number in a
source, and a task works a stretch off with a queue of its own. What a stretch sends on is one
message for that many leaves, written to the shared folder, so that a third of all documents in one
source are as many stretches of equal size. The backward sweep goes through the same stretches.

Digests are SHA-256 in lowercase hex, and inputs are concatenated as that text.

Defined results: ``-`` stands for a null field, so null and empty differ. Rows without source are a
source of their own, before all others. Leaves ascend by id, rows without id come last, rows with
equal ids go by their leaf; equal rows are leaves of their own. A source with one document has its
leaf as subroot, and one source its subroot as root. An empty table gives an empty table. Extra
columns are ignored whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import in_order
from tidewatch.session import cut_lineage

ARITY = 3
#: Levels of one stretch: it has at most 729 leaves.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: dict[str, Column]) -> Column:
    """``-`` for null, else byte count, ``:`` and value, one field after another."""
    parts = []
    for name in FIELDS:
        text = fields[name].cast("string")
        length = F.octet_length(text).cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(length, F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def levels_above(n: int, arity: int = ARITY) -> int:
    """Levels over ``n`` nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def forward(digests: list[str], levels: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """The digest that ``levels`` levels over ``digests`` end in, and the children of each node."""
    queue = [(0, number, 0, digest) for number, digest in enumerate(digests)]
    children: dict[tuple[int, int], list[str]] = {}
    # A list in the order of its labels is a heap.
    while queue:
        level, number, _, digest = heapq.heappop(queue)
        if level == levels:
            return digest, children
        own = [digest]
        while queue and queue[0][0] == level and queue[0][1] // ARITY == number // ARITY:
            own.append(heapq.heappop(queue)[3])
        parent = (level + 1, number // ARITY)
        children[parent] = own
        heapq.heappush(queue, (*parent, 0, sha256("".join(own).encode()).hexdigest()))
    raise ValueError("a tree has a leaf")


def backward(
    children: dict[tuple[int, int], list[str]], levels: int, last: list[dict]
) -> list[list[dict]]:
    """The steps from each leaf to the root; ``last`` are those of the stretch's own top.

    A step is the digests left and right of a node in its run.
    """
    queue: list[tuple[int, int, list[dict]]] = [(-levels, 0, last)]
    proofs: list[list[dict]] = []
    while queue:
        level, number, steps = heapq.heappop(queue)
        if level == 0:
            proofs.append(steps)
            continue
        own = children[(-level, number)]
        for i in range(len(own)):
            step = {"left": "".join(own[:i]), "right": "".join(own[i + 1 :])}
            heapq.heappush(queue, (level + 1, number * ARITY + i, [step, *steps]))
    return proofs


def fold_up(digest: str, steps: list[dict]) -> str:
    for step in steps:
        digest = sha256(f"{step['left']}{digest}{step['right']}".encode()).hexdigest()
    return digest


STEPS = "array<struct<left:string,right:string>>"
ARROW_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaves(docs: DataFrame, **columns: Column) -> DataFrame:
    """(doc_id, source, leaf, columns) with the leaf's ``tree``, its ``number`` there and the tree's ``n``."""
    spark = docs.sparkSession
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        leaf_digest({name: F.col(name) for name in FIELDS}).alias("leaf"),
        *[c.alias(n) for n, c in columns.items()],
    ).withColumn("copy", F.monotonically_increasing_id())
    own = cut_lineage(spark, own, "leaves")
    # Equal rows may go to different ranges.
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_last(), F.col("leaf"), F.col("copy")]
    placed = in_order(own, *order).drop("copy")
    trees = placed.groupBy("source").agg(F.min("at").alias("tree"), F.count("*").alias("n"))
    rows = placed.alias("p").join(trees.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    return rows.select("p.*", "tree", (F.col("at") - F.col("tree")).alias("number"), "n").drop("at")


def stretch() -> Column:
    return F.floor(F.col("number") / ARITY**HEIGHT).cast("long")


def stretch_tops(nodes: DataFrame) -> DataFrame:
    """The tops of the stretches of ``nodes`` (tree, number, n, digest), with the same columns; n: the
    number of nodes of the tree on that level."""
    schema = nodes.select("tree", "number", "n", "digest").schema

    def sweep(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.sort_by("number")
        n = own["n"][0].as_py()
        top, _ = forward(own["digest"].to_pylist(), min(HEIGHT, levels_above(n)))
        tree, number = (k.as_py() for k in key)
        return pa.table({"tree": [tree], "number": [number], "n": [-(-n // ARITY**HEIGHT)], "digest": [top]})

    own = nodes.select("tree", "number", "n", "digest", stretch().alias("stretch"))
    return own.groupBy("tree", "stretch").applyInArrow(sweep, schema)


def stretch_proofs(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """``nodes`` with ``steps``, from each to the root; ``tops`` (tree, number, steps): those of the
    stretches' tops."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = nodes.withColumn("steps", F.array().cast(STEPS)).schema
    names = [f.name for f in out][:-1]
    arrow = to_arrow_schema(out)

    def sweep(rows: pa.Table, tops: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return arrow.empty_table()
        rows = rows.sort_by("number")
        levels = min(HEIGHT, levels_above(rows["n"][0].as_py()))
        _, children = forward(rows["digest"].to_pylist(), levels)
        proofs = backward(children, levels, tops["steps"][0].as_py())
        return rows.select(names).append_column("steps", pa.array(proofs, ARROW_STEPS)).cast(arrow)

    left = nodes.withColumn("stretch", stretch()).groupBy("tree", "stretch")
    right = tops.select("tree", F.col("number").alias("stretch"), "steps").groupBy("tree", "stretch")
    return left.cogroup(right).applyInArrow(sweep, out)


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """``nodes``, the tops of their stretches, the tops of theirs and so on, up to one a tree."""
    levels = [nodes]
    while (levels[-1].agg(F.max("n")).first()[0] or 1) > 1:
        levels.append(cut_lineage(nodes.sparkSession, stretch_tops(levels[-1]), "tops"))
    return levels


def descended(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The first of ``levels`` with the ``steps`` of each node; ``tops`` has those of the last."""
    below = levels[-1].join(tops.select("tree", "steps"), "tree")
    for number, nodes in enumerate(reversed(levels[:-1])):
        if number:
            below = cut_lineage(nodes.sparkSession, below, "steps")
        below = stretch_proofs(nodes, below)
    return below


def manifest(docs: DataFrame, **columns: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, steps, columns) of each row of ``docs``.

    ``steps`` are the digests left and right of each node from the leaf to the root, in order.
    ``columns`` are further columns, computed on ``docs``.
    """
    spark = docs.sparkSession
    own = cut_lineage(spark, leaves(docs, **columns).withColumn("digest", F.col("leaf")), "manifest-leaves")
    by_tree = climbed(own)
    subroots = in_order(by_tree[-1].select("tree", "digest").distinct(), F.col("tree"))
    subroots = subroots.select("tree", F.col("at").alias("number"), "digest")
    n = subroots.count()
    sources = subroots.select(
        F.lit(0).cast("long").alias("tree"), "number", F.lit(n).cast("long").alias("n"), "digest", F.col("tree").alias("source_tree")
    )
    sources = cut_lineage(spark, sources, "subroots")
    over_sources = climbed(sources)
    top = over_sources[-1].select("digest").first()
    root = F.lit(top["digest"] if top else None).cast("string")
    from_root = descended(over_sources, over_sources[-1].select("tree", F.array().cast(STEPS).alias("steps")))
    named = cut_lineage(spark, from_root.select(F.col("source_tree").alias("tree"), "digest", "steps"), "source-steps")
    proofs = descended(by_tree, named)
    subroot = named.select("tree", F.col("digest").alias("subroot"))
    return proofs.join(subroot, "tree").select("doc_id", "leaf", "subroot", root.alias("root"), "steps", *columns)


def folded(rows: DataFrame, digest: str) -> DataFrame:
    """``rows`` with ``folded_root``, which ``digest`` and the row's steps lead to."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = rows.withColumn("folded_root", F.lit("")).schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [fold_up(d, s) for d, s in zip(batch[digest].to_pylist(), batch["steps"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.string())], schema=arrow)

    return rows.mapInArrow(run, out)


def proof_digest(steps: str = "steps") -> Column:
    """SHA-256 of all siblings from the leaf to the root."""
    joined = F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), "")
    return F.sha2(joined.cast("binary"), 256)


def tampered_leaf() -> Column:
    """The leaf after the text has lost its line breaks, where the id's checksum is even."""
    odd = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 != 0
    changed = F.when(F.col("doc_id").isNull() | odd, F.col("text")).otherwise(F.translate("text", "\n", ""))
    return leaf_digest({name: F.col(name) for name in FIELDS} | {"text": changed})


def audited(docs: DataFrame) -> DataFrame:
    """The manifest, and whether each row would still be found valid after the tampering."""
    rows = folded(manifest(docs, tampered=tampered_leaf()), "tampered")
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
