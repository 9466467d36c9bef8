"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams of bytes (3 to 5) of the lower-cased text with a space at each end, each
counted once a document and hashed into 2^20 buckets. On a sample of labelled documents the share
of toxic and of other documents holding a bucket gives its log-count ratio r; buckets whose ratio
is no more than noise get 0. A logistic regression on the r-scaled features is fitted, and its
weights times r, a table of fixed size, score every whole text in one pass without a shuffle.

The fit sees about ``per_class`` labelled documents and ``CLASS_BYTES`` of text of each class at most
(documented bounds), chosen by hash of id and text from all labelled documents outside the held-out
fold, however many rows repeat them; its intercept is moved to the shares of
the classes among all of them. It runs in one task over that bounded sample.

Defined results: null and empty texts have no features but the padding's and get the score that
the intercept gives. Without labelled rows of both classes the score is the share of 1 among the
labels, or 0 without labels. Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fold, labelled_sample, packs, sampled_texts, with_scores

GRAMS = (3, 4, 5)
BITS = 20
FOLDS, HELD_OUT = 5, 0
#: Labelled rows of each class that the fit may see.
PER_CLASS = 4000
#: Texts and characters whose n-grams are held at once; a longer text is a slice of its own.
SLICE, SLICE_CHARS = 256, 1 << 20
#: A log-count ratio counts if it is so many standard errors from 0.
NOISE = 3.5


def lowered(texts: list[str | None]) -> list[bytes]:
    return [b" " + (t or "").lower().encode("utf-8", "replace") + b" " for t in texts]


def gram_buckets(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each n, the bucket of the n-gram at each byte; the last n - 1 have none."""
    wide = data.astype(np.uint32)
    rolling = wide.copy()
    for n in range(2, max(GRAMS) + 1):
        rolling = rolling[:-1] * np.uint32(0x01000193) + wide[n - 1 :] * np.uint32(2 * n + 1)
        if n in GRAMS:
            mixed = rolling ^ (rolling >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B)
            yield n, (mixed >> np.uint32(32 - BITS))


def documents_with(texts: list[bytes], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs, of the buckets marked in ``wanted`` if given."""
    found, waiting = [np.zeros(0, np.int64)], 0
    for data, starts, owners in packs(texts, max(GRAMS) - 1):
        # Piece of each byte's place; an n-gram that holds the zero byte after a piece is none.
        ends = np.append(starts[1:], len(data)) - 1
        for n, buckets in gram_buckets(data):
            if wanted is None:
                at = np.arange(len(buckets))
            else:
                at = np.flatnonzero(wanted[buckets])
            piece = np.searchsorted(starts, at, side="right") - 1
            inside = at + n <= ends[piece]
            pairs = (owners[piece[inside]] << BITS) | buckets[at[inside]].astype(np.int64)
            found.append(np.unique(pairs))
            waiting += len(found[-1])
        # The pieces of a very long text repeat its pairs.
        if waiting > 1 << 22:
            found, waiting = [np.unique(np.concatenate(found))], 0
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def slices_of(texts: list[str | None]) -> list[slice]:
    """Neighbouring texts, at most ``SLICE`` of them and about ``SLICE_CHARS`` characters together."""
    out, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        if i > begin and (i - begin == SLICE or size + len(text or "") > SLICE_CHARS):
            out.append(slice(begin, i))
            begin, size = i, 0
        size += len(text or "")
    return [*out, slice(begin, len(texts))] if len(texts) else out


def logistic(blocks: list[tuple[np.ndarray, np.ndarray]], parts: list[slice], scale: np.ndarray, y: np.ndarray,
             rounds=300, ridge=1e-3):
    """Weights and intercept of a logistic regression, by accelerated gradient steps.

    A block holds (row within its part, column) of each entry; the entry's value is the column's scale.
    """
    n, n_features = len(y), len(scale)

    def by_row(of_column):
        each = [np.bincount(r, of_column[c], p.stop - p.start) for p, (r, c) in zip(parts, blocks, strict=True)]
        return np.concatenate(each) if each else np.zeros(0)

    def by_column(of_row):
        g = np.zeros(n_features)
        for p, (r, c) in zip(parts, blocks, strict=True):
            g += np.bincount(c, of_row[p][r], n_features)
        return g * scale

    # The largest row norm bounds the curvature far too high; grow the step while the loss falls.
    step = 1.0 / (0.25 * (by_row(scale**2).max(initial=0.0) + 1.0) + ridge)
    w, b, z = np.zeros(n_features), 0.0, np.zeros(n)
    m_w, m_b, m_z = w, b, z

    def loss(w, z):
        return np.mean(np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w

    best = loss(w, z)
    for t in range(1, rounds + 1):
        off = (1 / (1 + np.exp(-np.clip(m_z, -40, 40))) - y) / n
        new_w = m_w - step * (by_column(off) + ridge * m_w)
        new_b = m_b - step * off.sum()
        new_z = by_row(new_w * scale) + new_b
        value = loss(new_w, new_z)
        if value > best:
            step, m_w, m_b, m_z = step / 2, w, b, z
            continue
        # Margins are linear in the weights, so those of the point ahead need no pass of their own.
        momentum = (t - 1) / (t + 2)
        m_w, m_b, m_z = (new + momentum * (new - old) for new, old in ((new_w, w), (new_b, b), (new_z, z)))
        w, b, z, best, step = new_w, new_b, new_z, value, step * 1.1
    return w, b


def fit_grams(texts: list[str | None], y: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with their weights, and the intercept; ``share`` is the share of 1 to expect."""
    size = 1 << BITS
    # Once over the texts to count, once more for the buckets that matter: few, unlike all pairs.
    parts = slices_of(texts)
    with_1, with_0 = np.ones(size), np.ones(size)
    for part in parts:
        rows, buckets = documents_with(lowered(texts[part]), None)
        toxic = y[part][rows] == 1
        with_1 += np.bincount(buckets[toxic], minlength=size)
        with_0 += np.bincount(buckets[~toxic], minlength=size)
    n_1, n_0 = (y == 1).sum() + 2.0, (y == 0).sum() + 2.0
    ratio = np.log(with_1 / n_1) - np.log(with_0 / n_0)
    error = np.sqrt(1 / with_1 - 1 / n_1 + 1 / with_0 - 1 / n_0)
    chosen = np.flatnonzero(np.abs(ratio) > NOISE * error)
    column = np.full(size, -1, np.int32)
    column[chosen] = np.arange(len(chosen))
    blocks = []
    for part in parts:
        rows, buckets = documents_with(lowered(texts[part]), column >= 0)
        blocks.append((rows.astype(np.uint8), column[buckets]))
    scale = ratio[chosen]
    w, b = logistic(blocks, parts, scale, y.astype(float))
    expected = np.log(share / (1 - share)) - np.log(max(y.mean(), 1e-9) / max(1 - y.mean(), 1e-9))
    return chosen, w * scale, float(b + expected)


def fit_toxicity(docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = PER_CLASS,
                 folds: int = FOLDS, held_out: int = HELD_OUT):
    """(buckets, weights, intercept), at most 2^20 of them."""
    sample, counts = labelled_sample(docs, labels, column, per_class, folds, held_out)
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    nothing = np.zeros(0, np.int64), np.zeros(0)
    if share in (0.0, 1.0):
        return *nothing, (40.0 if share else -40.0)
    # At most about two times per_class documents.
    rows = sampled_texts(docs, sample)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch["text"].to_pylist()
            y += batch["label"].to_pylist()
        y = np.array(y, np.int64)
        if len(set(y.tolist())) < 2:
            buckets, weights, intercept = *nothing, float(np.log(share / (1 - share)))
        else:
            # In the order of the texts, so that a rerun sums in the same order.
            order = sorted(range(len(texts)), key=lambda i: (texts[i] or "", y[i]))
            buckets, weights, intercept = fit_grams([texts[i] for i in order], y[order], share)
        yield pa.RecordBatch.from_pydict(
            {"bucket": np.append(buckets, -1), "weight": np.append(weights, intercept)}
        )

    fitted = rows.select("text", "label").repartition(1).mapInArrow(fit, "bucket long, weight double").toPandas()
    if fitted.empty:
        return *nothing, float(np.log(share / (1 - share)))
    is_weight = fitted["bucket"].to_numpy() >= 0
    return (
        fitted["bucket"].to_numpy()[is_weight],
        fitted["weight"].to_numpy()[is_weight],
        float(fitted["weight"].to_numpy()[~is_weight][0]),
    )


def score_toxicity(docs: DataFrame, model, *columns: str, threshold: float = 0.5) -> DataFrame:
    """Each row's ``columns`` with ``score`` and ``predicted``."""
    buckets, weights, intercept = model
    size = 1 << BITS
    shared = docs.sparkSession.sparkContext.broadcast((buckets, weights.astype(np.float64)))

    def score(texts: list) -> dict:
        buckets, weights = shared.value
        table = np.zeros(size)
        table[buckets] = weights
        wanted = np.zeros(size, bool)
        wanted[buckets] = True
        z = np.zeros(len(texts))
        for part in slices_of(texts):
            owners, found = documents_with(lowered(texts[part]), wanted)
            z[part] = np.bincount(owners, table[found], part.stop - part.start)
        z = np.clip(z + intercept, -40, 40)
        p = 1 / (1 + np.exp(-z))
        return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

    return with_scores(docs, columns, score, "score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score_toxicity(docs, fit_toxicity(docs, labels), "doc_id")
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        "predicted",
    )
