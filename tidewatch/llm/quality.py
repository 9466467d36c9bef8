"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are documents labelled 1. Unlabelled are documents of the whole table but the
held-out fold, whatever their label. With the class prior pi, the risk of a score g is

    pi E_P[loss(g)] + max(0, E_U[loss(-g)] - pi E_P[loss(-g)])

for the logistic loss, so that the fitted score is a probability. When the second term turns
negative by more than its sampling error, the step goes against it, as the estimator prescribes, so
that flexible features do not overfit the unlabelled texts. The prior is estimated from scores of
unlabelled rows and of positives that were held back; labels of 0 are used nowhere.

Features describe the shape of the text, each cut into bins at quantiles of the sample: shares of
capitals, digits, symbols, separators and other marks, repeated neighbouring words, variety of
words in stretches of 64, lengths of words and lines. Language and source play no part.

The fit sees at most about ``per_class`` positives and twice as many unlabelled rows (documented
bounds), chosen by hash; all rows are scored over their whole texts.

Defined results: null and empty texts have all shares 0. Without positives every score is 0.
Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import CLASS_BYTES, drawn, fold, keyed, labelled_sample, map_batches, sampled_texts, with_scores
from tidewatch.session import cut_lineage

FOLDS, HELD_OUT = 4, 2
PER_CLASS = 6000
BINS = 12
THRESHOLD = 0.7
SHAPES = 13


def _class_table() -> np.ndarray:
    """Bytes by kind: 1 small letter, 2 capital, 3 digit, 4 white space, 5 stop, comma or quote,
    6 exclamation mark, 7 bar, 8 other mark, 9 part of a letter beyond ASCII."""
    kinds = np.full(256, 8, np.uint8)
    kinds[97:123], kinds[65:91], kinds[48:58], kinds[128:] = 1, 2, 3, 9
    kinds[[9, 10, 11, 12, 13, 32]] = 4
    for mark in b".,;:'\"-()?":
        kinds[mark] = 5
    kinds[ord("!")], kinds[ord("|")] = 6, 7
    return kinds


KINDS = _class_table()


def shapes(text: str | None) -> list[float]:
    """The features of one text before binning."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    if not len(data):
        return [0.0] * SHAPES
    kinds = KINDS[data]
    counts = np.bincount(kinds, minlength=10).astype(float)
    letters = counts[1] + counts[2] + counts[9] + 1
    inside = kinds != 4
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    begins, ends = edges[::2], edges[1::2]
    lengths = ends - begins
    words = len(begins)
    if not words:
        return [0.0] * SHAPES
    # A word's hash: bytes weighed by their place from the word's start.
    place = np.arange(len(data)) - np.repeat(np.append(0, begins), np.diff(np.concatenate(([0], begins, [len(data)]))))
    place = place.astype(np.uint64)
    with np.errstate(over="ignore"):
        terms = (data.astype(np.uint64) + np.uint64(1)) * (place * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))
        terms ^= terms >> np.uint64(29)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))
        hashes = sums[ends] - sums[begins]
    same = float(np.mean(hashes[1:] == hashes[:-1])) if words > 1 else 0.0
    # Distinct words in each stretch of 64, which does not depend on the length of the text.
    stretch = np.arange(words) // 64
    order = np.lexsort((hashes, stretch))
    new = np.ones(words, bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (stretch[order][1:] != stretch[order][:-1])
    lines = float((data == 10).sum() + 1)
    first = float(np.mean(kinds[begins] == 2))
    size = float(len(data))
    return [
        counts[2] / letters,
        counts[3] / size,
        counts[5] / size,
        counts[6] / words,
        counts[7] / words,
        counts[8] / words,
        same,
        float(new.mean()),
        float(lengths.mean()),
        float(lengths.max()),
        words / lines,
        first,
        float(np.log1p(words)),
    ]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The column of each feature's bin in a one-hot matrix."""
    return np.stack(
        [np.searchsorted(e, x[:, j], side="left") + j * BINS for j, e in enumerate(edges)], axis=1
    )


def quantile_edges(x: np.ndarray) -> list[np.ndarray]:
    """The smallest value has a bin of its own (most shares are 0 in most texts); quantiles of the
    values above it divide the rest."""
    edges = []
    for column in x.T:
        above = column[column > column.min()]
        cuts = np.quantile(above, np.linspace(0, 1, BINS)[1:-1]) if len(above) else []
        edges.append(np.unique(np.append(column.min(), cuts)))
    return edges


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1500,
           rate: float = 0.05, ridge: float = 1e-4, non_negative: bool = True) -> np.ndarray:
    """Weights (the last is the intercept) that minimise the non-negative risk, by Adam.

    Rows are the columns of ones of each document.
    """
    size = SHAPES * BINS
    w = np.zeros(size + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def z(rows):
        return w[rows].sum(axis=1) + w[-1]

    def slope(rows, each):
        g = np.zeros_like(w)
        g[:size] = np.bincount(rows.ravel(), np.repeat(each, rows.shape[1]), size)
        g[-1] = each.sum()
        return g

    for t in range(1, rounds + 1):
        zp, zu = np.clip(z(positive), -40, 40), np.clip(z(unlabelled), -40, 40)
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        # loss(g) = log(1 + exp(-g)) for positives, loss(-g) = log(1 + exp(g)) against.
        against = np.logaddexp(0, zp)
        rest = np.mean(np.logaddexp(0, zu)) - prior * np.mean(against)
        # The difference of two samples' means; below 0 by more than its sampling error is overfit.
        slack = 3 * prior * np.std(against) * np.sqrt(1 / len(zp) + 1 / len(zu))
        g_rest = slope(unlabelled, su / len(su)) - prior * slope(positive, sp / len(sp))
        if non_negative and rest < -slack:
            g = -g_rest
        else:
            g = prior * slope(positive, (sp - 1) / len(sp)) + g_rest
        g[:size] += ridge * w[:size]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        w = w - rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 4) -> float:
    """Mean score of unlabelled rows over that of positives, each by a plain classifier that saw it not.

    Rows are dealt into folds by what they look like, so a document that is both a positive and unlabelled
    is in one fold as both.
    """
    place = np.arange(1, SHAPES + 1) * 2654435761
    own = [((rows * place).sum(axis=1) >> 7) % folds for rows in (positive, unlabelled)]
    if any(len(np.unique(f)) < folds for f in own):
        own = [np.arange(len(rows)) % folds for rows in (positive, unlabelled)]
    sums = np.zeros(2)
    for fold_number in range(folds):
        out = [f == fold_number for f in own]
        if not all((~o).any() for o in out):
            continue
        w = fit_pu(positive[~out[0]], unlabelled[~out[1]], 0.5, rounds=300, non_negative=False)
        for side, rows in enumerate((positive[out[0]], unlabelled[out[1]])):
            sums[side] += (1 / (1 + np.exp(-np.clip(w[rows].sum(axis=1) + w[-1], -40, 40)))).sum()
    means = sums / (len(positive), len(unlabelled))
    return float(np.clip(means[1] / max(means[0], 1e-9), 0.05, 0.98))


def fit_quality(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = PER_CLASS,
                folds: int = FOLDS, held_out: int = HELD_OUT):
    """(bin edges, weights), or None without positives."""
    sample, counts = labelled_sample(docs, labels, column, per_class, folds, held_out)
    if not counts.get(1):
        return None
    spark = docs.sparkSession
    sized = keyed(docs).where(fold("doc_id", folds) != held_out)
    sized = sized.select("doc_id", "text_key", F.octet_length("text").cast("long").alias("bytes")).distinct()
    sized = cut_lineage(spark, sized, "unlabelled-documents")
    total = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    rate = 2 * min(per_class / max(total["n"], 1), CLASS_BYTES / max(total["bytes"], 1))
    unlabelled = drawn(sized, rate, 23).select("doc_id", "text_key", F.lit(False).alias("trusted"))
    positives = sample.where("label = 1").select("doc_id", "text_key", F.lit(True).alias("trusted"))
    picked = sampled_texts(docs, positives).unionByName(sampled_texts(docs, unlabelled))
    # At most about three times per_class rows of 13 numbers.
    rows = map_batches(picked.select("trusted", "text"), _describe, "trusted boolean, x array<double>").toPandas()
    x = np.array(rows["x"].tolist()).reshape(-1, SHAPES)
    order = np.lexsort(x.T)
    x, trusted = x[order], rows["trusted"].to_numpy()[order]
    if not trusted.any() or trusted.all():
        return None
    edges = quantile_edges(x[~trusted])
    columns = binned(x, edges)
    prior = estimated_prior(columns[trusted], columns[~trusted])
    return edges, fit_pu(columns[trusted], columns[~trusted], prior)


def _describe(rows: dict) -> dict:
    return {"trusted": rows["trusted"], "x": [shapes(t) for t in rows["text"]]}


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit_quality(docs, labels)

    def score(texts: list) -> dict:
        p = np.zeros(len(texts))
        if model is not None:
            edges, w = model
            columns = binned(np.array([shapes(t) for t in texts]), edges)
            p = 1 / (1 + np.exp(-np.clip(w[columns].sum(axis=1) + w[-1], -40, 40)))
        return {"score": p, "predicted": (p >= threshold).astype(np.int32)}

    scored = with_scores(docs, ("doc_id",), score, "score double, predicted int")
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        "predicted",
    )
