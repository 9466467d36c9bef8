"""Vector code compression: parts of vectors become indexes into small codebooks.

Components become floor(4096 * x). Vectors are cut into 8 consecutive parts; each position has a
codebook of 16 entries, first those parts of the 16 smallest ids, which six rounds of assigning and
averaging move.

An assignment is looked up by grid cell. A part's coarse cell is the box of whole numbers around it;
an entry whose least distance to the box is above some other entry's greatest distance is not the
nearest of any part in the box, ties included. The entries that are left for a cell are cached under
its hash, and a part is compared exactly with only those of its cell. The cache of a task begins
anew when it holds ``CELLS`` cells, which costs time and changes nothing. Hashes that collide are
told apart by the cells themselves.

Every round is one pass over the vectors' whole numbers, written once. A task sends on sums and
counts of each entry, whole numbers that add up alike in any order; the codebooks, 128 entries, are
the only thing on the driver.

Defined results: vectors that are null or hold null or non-finite components are dropped. The longest
vector's length, rounded up to a multiple of 8, is everyone's; shorter ones are filled up with
zeros. Components are held within +-2^28 (x within +-65,536), so that distances fit a long with up to
248 components. Rows without id
come last in the choice of entries, equal ids go by their components. Repeated rows each count and each get a
code. With fewer than 16 vectors there are as many entries. Null labels add up together. Sums that
pass a long fail the job instead of wrapping. An empty table gives an empty table. Extra columns are
ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordering import null_safe_join
from tidewatch.session import cut_lineage

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE, LARGEST = 4096, 1 << 28
#: Cells whose entries a task remembers, for each part position.
CELLS = 1 << 16
#: Vectors that are worked on at once.
TOGETHER = 4096


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, whole): the components as whole numbers, of usable vectors."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = lambda x: F.least(F.greatest(F.floor(x * SCALE), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    # Far beyond the range a double times the scale may not fit a long.
    inside = lambda x: F.least(F.greatest(x, F.lit(-1e9)), F.lit(1e9))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", vector.alias("vector"))
        .where(F.col("vector").isNotNull() & fine)
        .select("vec_id", "label", F.transform("vector", lambda x: held(inside(x))).alias("whole"))
    )


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column, filled up with zeros to ``width``."""
    rows = len(column)
    lengths = np.diff(column.offsets.to_numpy()) if rows else np.zeros(0, int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return flat.reshape(rows, width)
    out = np.zeros((rows, width), np.int64)
    out[np.repeat(np.arange(rows), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Nearest:
    """The nearest entry of one codebook, by cells whose possible entries are remembered."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        entries, width = book.shape
        apart = np.sqrt(((book[:, None] - book[None]).astype(float) ** 2).sum(axis=2))
        # A box of half the usual distance between entries, across its diagonal.
        wide = apart.sum() / max(entries * (entries - 1), 1) / (2 * max(width, 1) ** 0.5)
        self.shift = max(0, int(np.log2(max(wide, 1.0))))
        self.cache: dict[int, tuple[bytes, int]] = {}
        rng = np.random.default_rng(width)
        self.mix = rng.integers(1, 1 << 62, width, dtype=np.int64) | 1
        self.evaluated = self.looked_up = self.made = 0

    def possible(self, cells: np.ndarray) -> np.ndarray:
        """A bit for each entry that may be the nearest within the cell."""
        low = (cells << self.shift)[:, None]
        high = low + (1 << self.shift) - 1
        below, above = low - self.book, self.book - high
        least = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        most = (np.maximum(np.abs(below), np.abs(above)) ** 2).sum(axis=2)
        stays = least <= most.min(axis=1, keepdims=True)
        return (stays << np.arange(len(self.book))).sum(axis=1)

    def masks(self, parts: np.ndarray) -> np.ndarray:
        cells = parts >> self.shift
        with np.errstate(over="ignore"):
            hashes = ((cells ^ (cells << 7)) * self.mix).sum(axis=1)
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        own = cells[first]
        names = [row.tobytes() for row in own]
        known = [self.cache.get(h) for h in distinct.tolist()]
        found = np.fromiter((k[1] if k and k[0] == n else 0 for k, n in zip(known, names, strict=True)), np.int64, len(own))
        # No cell is without an entry, so 0 is none known.
        missing = np.flatnonzero(found == 0)
        found[missing] = self.possible(own[missing])
        if len(self.cache) + len(missing) > CELLS:
            self.cache.clear()
        for i in missing.tolist():
            self.cache[int(distinct[i])] = (names[i], int(found[i]))
        masks = found[of]
        strangers = np.flatnonzero((own[of] != cells).any(axis=1))
        masks[strangers] = self.possible(cells[strangers])
        self.looked_up += len(own)
        self.made += len(missing)
        return masks

    def __call__(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each part, ties to the lower index."""
        masks = self.masks(parts)
        best = np.full(len(parts), np.iinfo(np.int64).max)
        index = np.zeros(len(parts), np.int64)
        for entry, centre in enumerate(self.book):
            rows = np.flatnonzero(masks >> entry & 1)
            distance = ((parts[rows] - centre) ** 2).sum(axis=1)
            nearer = distance < best[rows]
            best[rows[nearer]], index[rows[nearer]] = distance[nearer], entry
            self.evaluated += len(rows)
        return index, best


def in_parts(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """A few rows at a time, with their parts: (rows, part, component)."""
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(at, TOGETHER)
            yield rows, matrix(rows["whole"], width).reshape(rows.num_rows, PARTS, width // PARTS)


def moved(whole: DataFrame, books: np.ndarray, width: int) -> np.ndarray:
    """The codebooks after one round of assigning and averaging."""
    shared = whole.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        nearest = [Nearest(book) for book in books]
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for _, parts in in_parts(batches, width):
            for p, find in enumerate(nearest):
                index, _ = find(parts[:, p])
                np.add.at(sums[p], index, parts[:, p])
                counts[p] += np.bincount(index, minlength=books.shape[1])
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(used[:, 0], pa.int32()), "entry": pa.array(used[:, 1], pa.int32()),
            "n": counts[used[:, 0], used[:, 1]], "sums": pa.array(list(sums[used[:, 0], used[:, 1]]), pa.list_(pa.int64())),
        })

    added = whole.select("whole").mapInArrow(add_up, "part int, entry int, n long, sums array<long>")
    by_place = added.select("part", "entry", "n", F.posexplode("sums").alias("place", "component"))
    # As many rows as the codebooks have components.
    rows = by_place.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("component").alias("total")).toArrow()
    shared.destroy()
    at = tuple(rows[name].to_numpy() for name in ("part", "entry", "place"))
    new = books.copy()
    new[at] = np.floor_divide(rows["total"].to_numpy(), rows["n"].to_numpy())
    return new


def fit_codebooks(whole: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, component) after ``rounds`` rounds; no entries without vectors."""
    longest = whole.agg(F.max(F.size("whole"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    # As many rows as a codebook has entries.
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()
    start = np.zeros((len(first), width), np.int64)
    for row, own in zip(start, first, strict=True):
        row[: len(own["whole"])] = own["whole"]
    books = start.reshape(len(first), PARTS, width // PARTS).transpose(1, 0, 2).copy()
    for _ in range(rounds if len(first) and width else 0):
        books = moved(whole, books, width)
    return books


def encoded(whole: DataFrame, books: np.ndarray, schema: str) -> DataFrame:
    """Each row's other columns with ``code`` and ``error``."""
    from tidewatch.llm.common import to_arrow

    width = books.shape[0] * books.shape[2]
    # 128 entries of one vector's components.
    shared = whole.sparkSession.sparkContext.broadcast(books)
    arrow = to_arrow(whole.sparkSession, schema)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nearest = [Nearest(book) for book in shared.value]
        for rows, parts in in_parts(batches, width):
            indexes, errors = np.zeros((rows.num_rows, PARTS), np.uint8), np.zeros(rows.num_rows, np.int64)
            for p, find in enumerate(nearest):
                indexes[:, p], error = find(parts[:, p])
                errors += error
            texts = [row.tobytes().hex() for row in indexes]
            others = [rows[f.name] for f in list(arrow)[:-2]]
            yield pa.RecordBatch.from_arrays([*others, pa.array(texts), pa.array(errors)], schema=arrow)

    return whole.mapInArrow(code, schema)


def book_digest(books: np.ndarray) -> str:
    return sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each usable row of ``vectors``."""
    spark = vectors.sparkSession
    whole = cut_lineage(spark, whole_numbers(vectors), "whole-numbers")
    books = fit_codebooks(whole)
    label = whole.schema["label"].dataType.simpleString()
    coded = encoded(whole, books, f"vec_id long, label {label}, code string, error long")
    coded = cut_lineage(spark, coded, "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    both = null_safe_join(coded, by_label, ["label"])
    return both.select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
