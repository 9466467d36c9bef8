"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; its letters stay and each run of other characters becomes one space, with one
space at either end. The n-grams (1 to 3 characters) are hashed into buckets. Every learning
document adds its n-gram counts to its language: tasks count, one aggregate adds up. The smoothed
log probabilities, one row for each language, are a matrix of bounded size that is broadcast; it
scores whole texts in batches by gathering the rows of the buckets and summing them by text.

Log probabilities are held as whole multiples of 2^-16. Their sums are exact, so neither batches
nor pieces of a long text change a result, and equal texts have equal scores.

Bounds: the matrix holds at most ``MODEL_BYTES``. The number of buckets is the largest power of two
up to 2^16 that keeps it; more languages than leave 2^8 buckets are refused. Nothing is sampled.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if there was nothing to
learn from. Otherwise the language of the largest posterior, ties to the first by code point, and
``score`` is that posterior. Documents without id are in fold 0. A text that occurs twice is learnt
twice. Extra columns are ignored whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fold, text_slices, with_scores

LONGEST = 3
BITS, LEAST_BITS = 16, 8
MODEL_BYTES = 64 << 20
FOLDS, HELD_OUT = 3, 1
#: Added to each count, so that no n-gram is impossible.
SMOOTHING = 0.1
UNIT = 2.0**16
UNKNOWN = "und"
#: Characters that are hashed at once; a longer text is read in pieces of this length.
PIECE = 1 << 18
SPACE = 32


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Of each code point, if it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)


def squeezed(own: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters, a space for each other character that follows a letter, or is marked in ``stay``;
    and what is kept."""
    letter = letters()[own]
    keep = letter | stay
    keep[1:] |= letter[:-1]
    return np.where(letter, own, np.uint32(SPACE))[keep], keep


def grams(own: np.ndarray, region: np.ndarray, known: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (bucket, region) of the n-grams within one region that end behind ``known`` codes."""
    rolling = np.zeros(len(own), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(own) < n:
            return
        tail = own[n - 1 :]
        rolling = rolling[: len(tail)] * np.uint32(0x01000193) + tail + np.uint32(0x9E3779B9)
        mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
        mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        inside = region[n - 1 :] == region[: len(tail)]
        inside[: max(0, known - n + 1)] = False
        if n == 1:
            # A lone space says nothing.
            inside &= own != SPACE
        yield (mixed >> np.uint32(32 - bits))[inside], region[: len(tail)][inside]


def text_grams(texts: list[str | None], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, number of its text) of all n-grams, some texts or a piece of one text at a time.

    Numbers do not fall within one yielded pair.
    """
    waiting: list[tuple[int, str]] = []
    size = 0
    for number, text in enumerate(texts):
        if not text:
            continue
        if len(text) > PIECE:
            yield from _long(number, text, bits)
            continue
        if size + len(text) > PIECE and waiting:
            yield from _packed(waiting, bits)
            waiting, size = [], 0
        waiting.append((number, text))
        size += len(text) + 2
    if waiting:
        yield from _packed(waiting, bits)


def _packed(waiting: list[tuple[int, str]], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    parts = [codes(f" {text} ") for _, text in waiting]
    region = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    own = np.concatenate(parts)
    # Each text begins with its own space, which stays.
    begins = np.zeros(len(own), bool)
    begins[np.cumsum([0, *[len(p) for p in parts[:-1]]])] = True
    own, keep = squeezed(own, begins)
    numbers = np.array([number for number, _ in waiting])
    for bucket, at in grams(own, region[keep], 0, bits):
        yield bucket, numbers[at]


def _long(number: int, text: str, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each piece follows the last codes of the one before, which begin no n-gram that was known."""
    carried, known, after_letter = np.full(1, SPACE, np.uint32), 0, False
    for at in range(0, len(text) + 1, PIECE):
        piece = codes(text[at : at + PIECE] + (" " if at + PIECE > len(text) else ""))
        stay = np.zeros(len(piece), bool)
        stay[:1] = after_letter
        own, _ = squeezed(piece, stay)
        after_letter = bool(letters()[piece[-1]])
        whole = np.concatenate((carried, own))
        for bucket, at_code in grams(whole, np.zeros(len(whole), np.int8), known, bits):
            yield bucket, np.full(len(at_code), number)
        carried = whole[-(LONGEST - 1) :]
        known = len(carried)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def bits_for(languages: int) -> int:
    bits = min(BITS, (MODEL_BYTES // (4 * max(languages, 1))).bit_length() - 1)
    if bits < LEAST_BITS:
        raise ValueError(f"{languages} languages leave no room for n-grams in {MODEL_BYTES} bytes")
    return bits


def fit_languages(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> tuple[list[str], np.ndarray]:
    """The languages, and for each bucket and language the log probability in units of 2^-16.

    The last row is the log share of each language among the learning documents.
    """
    spark = docs.sparkSession
    learning = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")
    ).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_out))
    most = MODEL_BYTES // 4 >> LEAST_BITS
    # One row for each language; more than ``most`` of them are refused below.
    shares = learning.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(most + 1).collect()
    languages = [row["lang"] for row in shares]
    bits = bits_for(len(languages))
    if not languages:
        return [], np.zeros((1, 0), np.int32)
    place = {lang: i for i, lang in enumerate(languages)}
    buckets = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for part in text_slices(batch, "text"):
                own = np.array([place[lang] for lang in part["lang"].to_pylist()])
                for bucket, number in text_grams(part["text"].to_pylist(), bits):
                    spoken = own[number]
                    for lang in np.unique(spoken).tolist():
                        if lang not in counts:
                            counts[lang] = np.zeros(buckets, np.int64)
                        counts[lang] += np.bincount(bucket[spoken == lang], minlength=buckets)
        for lang, found in counts.items():
            held = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), lang), pa.int32()), pa.array(held, pa.int32()), pa.array(found[held])],
                ["lang", "bucket", "n"],
            )

    counted = learning.select("text", "lang").mapInArrow(count, "lang int, bucket int, n long")
    # At most one row for each bucket and language: as many as the model has cells.
    found = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((buckets, len(languages)), SMOOTHING)
    table[found["bucket"].to_numpy(), found["lang"].to_numpy()] += found["n"].to_numpy()
    logs = np.log(table) - np.log(table.sum(axis=0))
    prior = np.log([row["n"] for row in shares]) - np.log(sum(row["n"] for row in shares))
    return languages, np.rint(np.vstack((logs, prior)) * UNIT).astype(np.int32)


def posterior(texts: list[str | None], model: np.ndarray) -> np.ndarray:
    """Of each text, the log joint probability with each language, in units of 2^-16."""
    buckets, languages = len(model) - 1, model.shape[1]
    bits = buckets.bit_length() - 1
    sums = np.tile(model[-1].astype(np.int64), (len(texts), 1))
    at_once = max(1, (1 << 21) // max(languages, 1))
    for bucket, number in text_grams(texts, bits):
        for at in range(0, len(bucket), at_once):
            own = number[at : at + at_once]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            gathered = model[bucket[at : at + at_once]]
            sums[own[first]] += np.add.reduceat(gathered, first, axis=0, dtype=np.int64)
    return sums


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], *columns: str) -> DataFrame:
    """Each row's ``columns`` with ``lang_pred`` and ``score``."""
    languages, logs = model
    # At most MODEL_BYTES, see ``bits_for``.
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def score(texts: list) -> dict:
        named, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if languages:
            sums = posterior(texts, shared.value)
            best = sums.argmax(axis=1)
            away = (sums - sums[np.arange(len(texts)), best][:, None]) / UNIT
            posteriors = 1 / np.exp(away).sum(axis=1)
            for i, text in enumerate(texts):
                if has_letter(text):
                    named[i], sure[i] = languages[best[i]], posteriors[i]
        return {"lang_pred": named, "score": sure}

    return with_scores(docs, columns, score, "lang_pred string, score double")


def language_id(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    found = identify(docs, fit_languages(docs), "doc_id")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "lang_pred",
        "score",
    )
