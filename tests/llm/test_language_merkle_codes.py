"""Language ID, the Merkle manifest and vector codes against plain Python, over odd rows."""

import math
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import codes, langid, merkle, plans

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, tree long, digest string"


def made(rows):
    return [(i, text, lang, source, n, 0.5, 7, "x") for i, text, lang, source, n in rows]


def language_rows():
    rng = np.random.default_rng(1)
    words = {
        "de": ["der", "und", "straße", "wetter", "fluss", "über", "berge"],
        "en": ["the", "and", "street", "weather", "river", "over", "hills"],
        "日本": ["日本語", "テキスト", "川", "山の上", "天気"],
    }
    rows = []
    for i in range(240):
        lang = list(words)[i % 3]
        text = ", ".join(rng.choice(words[lang], 3 + i % 5))
        rows.append((i, text.upper() if i % 4 else text, lang if i % 5 else None, "s", len(text)))
    odd = [None, "", " \n\t", "12 + 34 = 46!", "é", "der " * 30_000, "the river " * 90_000 + "x", "ΣΑΣ \x00 \U0001f600 ok"]
    rows += [(1000 + i, text, "en" if i == 6 else None, None, None) for i, text in enumerate(odd)]
    return made([*rows, (None, "the hills", "en", "s", 9), rows[1], rows[1]])


def plain_grams(text):
    own = "".join(c if c.isalpha() else " " for c in text.lower())
    own = " " + " ".join(own.split()) + (" " if own.strip() else "")
    for n in (1, 2, 3):
        for at in range(len(own) - n + 1):
            if own[at : at + n] != " ":
                yield own[at : at + n]


def bucket(gram, bits):
    value = 0
    for c in gram:
        value = (value * 0x01000193 + ord(c) + 0x9E3779B9) % 2**32
    value = (value ^ value >> 15) * (0x85EBCA6B + 2 * len(gram)) % 2**32
    return (value ^ value >> 13) * 0xC2B2AE35 % 2**32 >> 32 - bits


def held_out(doc_id, folds, rest):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == rest


def plain_languages(rows, bits):
    counts, shares = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for doc_id, text, lang, *_ in rows:
        if lang is not None and text is not None and not held_out(doc_id, 3, 1):
            shares[lang] += 1
            for gram in plain_grams(text):
                counts[lang][bucket(gram, bits)] += 1
    langs = sorted(shares)
    total = {lang: sum(counts[lang].values()) + 0.1 * 2**bits for lang in langs}
    log = lambda lang, b: round((math.log(counts[lang].get(b, 0) + 0.1) - math.log(total[lang])) * 2**16)
    found = []
    for _, text, *_ in rows:
        if text is None or not any(map(str.isalpha, text)):
            found.append(("und", 0.0))
            continue
        each = defaultdict(int)
        for gram in plain_grams(text):
            each[bucket(gram, bits)] += 1
        sums = [round((math.log(shares[lang]) - math.log(sum(shares.values()))) * 2**16) + sum(log(lang, b) * n for b, n in each.items()) for lang in langs]
        best = max(range(len(langs)), key=lambda i: sums[i])
        found.append((langs[best], 1 / sum(math.exp((s - sums[best]) / 2**16) for s in sums)))
    return found


@pytest.mark.parametrize("piece", [1 << 18, 37])
def test_languages_against_plain_naive_bayes(spark, piece, monkeypatch):
    monkeypatch.setattr(langid, "PIECE", piece)
    rows = language_rows()
    if piece < 1000:
        rows = [r for r in rows if len(r[1] or "") < 20_000]
    docs = spark.createDataFrame(rows, DOCS).repartition(3).cache()
    model = langid.fit_languages(docs)
    own = [{"id": r[0], "text": r[1]} for r in rows]
    sums = langid.posterior([r["text"] for r in own], model[1])
    expected = plain_languages(rows, 16)
    got = langid.language_id(docs).toPandas()
    assert len(got) == len(rows) and got.columns.tolist() == ["doc_id", "held_out", "lang_pred", "score"]
    by_text = {r["text"]: e for r, e in zip(own, expected, strict=True)}
    shown = langid.identify(docs, model, "doc_id", "text", "score", "lang").collect()
    for r in shown:
        lang, score = by_text[r["text"]]
        assert r["lang_pred"] == lang and abs(r[-1] - score) < 1e-9
    assert sums.shape == (len(rows), 3)
    assert got[got["held_out"]]["doc_id"].map(lambda i: held_out(int(i), 3, 1)).all()
    assert got["held_out"].sum() == sum(held_out(r[0], 3, 1) for r in rows)


def test_languages_of_rows_that_were_not_learnt(spark):
    # Counts of n-grams follow the length of a text: 90,000 times "the river" would be all that English is.
    rows = [r for r in language_rows() if len(r[1] or "") < 20_000]
    docs = spark.createDataFrame(rows, DOCS)
    truth = {r[0]: r[2] for r in rows}
    got = [r for r in langid.language_id(docs).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert len(got) > 40 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.97


def test_nothing_to_learn_from_and_too_many_languages(spark):
    docs = spark.createDataFrame(made([(1, "the river", None, "s", 1), (4, None, "en", "s", 1)]), DOCS)
    assert {(r["lang_pred"], r["score"]) for r in langid.language_id(docs).collect()} == {("und", 0.0)}
    assert langid.language_id(docs.limit(0)).count() == 0
    assert langid.bits_for(4) == 16 and langid.bits_for(5000) == 11
    with pytest.raises(ValueError):
        langid.bits_for(10**6)


def test_held_out_languages_of_the_tables(spark, folder):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = [r for r in plans.op11_language_id(spark, folder).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in got]) > 0.95


def plain_leaf(fields):
    joined = b""
    for value in fields:
        data = str(value).encode() if value is not None else b""
        joined += b"-" if value is None else str(len(data)).encode() + b":" + data
    return sha256(joined).hexdigest()


def plain_tree(digests):
    """The root, and the siblings of each leaf from below."""
    proofs, holds = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, over = [], []
        for at in range(0, len(digests), 3):
            run = digests[at : at + 3]
            for i, held in enumerate(holds[at : at + 3]):
                for leaf in held:
                    proofs[leaf].append((run[:i], run[i + 1 :]))
            above.append(sha256("".join(run).encode()).hexdigest())
            over.append(sum(holds[at : at + 3], []))
        digests, holds = above, over
    return digests[0], proofs


def plain_manifest(rows):
    trees = defaultdict(list)
    for i, text, lang, source, n, *_ in rows:
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        other = text.replace("\n", "") if text is not None and even else text
        trees[source].append((i is None, i or 0, plain_leaf((i, source, lang, n, text)), plain_leaf((i, source, lang, n, other)), i))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: plain_tree([leaf[2] for leaf in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    root, over = plain_tree([built[s][0] for s in order])
    for s, above in zip(order, over, strict=True):
        for (_, _, leaf, tampered, i), own in zip(sorted(trees[s], key=lambda x: x[:3]), built[s][1], strict=True):
            steps = [*own, *above]
            siblings = "".join("".join(a) + "".join(b) for a, b in steps)
            end = tampered
            for a, b in steps:
                end = sha256(("".join(a) + end + "".join(b)).encode()).hexdigest()
            yield (i, leaf, built[s][0], root, sha256(siblings.encode()).hexdigest(), end, end == root)


def manifest_rows():
    rows = [(i, f"text {i}\nline" if i % 3 else f"one line {i}", "en", "hot" if i % 3 else f"s{i % 7}", i) for i in range(120)]
    rows += [(500, None, None, None, None), (501, "", "", "", 0), (502, "é\n\n日本", "fr", "ß", 5), (503, "a" * 300_000 + "\n", "en", "alone", 1)]
    rows += [(None, "no id\n", "en", "hot", 1), (None, "no id\n", "en", "hot", 1), (7, "another text\nof this id", "en", "hot", 7)]
    return made([*rows, rows[4], rows[4], (600, "x", None, None, 1)])


@pytest.mark.parametrize("height", [1, 2, 6])
def test_manifest_against_plain_trees(spark, height, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = manifest_rows()
    got = merkle.audited(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, plain_manifest(rows)))
    assert 0 < sum(r["verified"] for r in got) < len(got)


@pytest.mark.parametrize("n", [0, 1, 2, 4, 28])
def test_small_manifests(spark, n):
    rows = made([(i, f"t\n{i}", "en", "one source", 1) for i in range(n)])
    got = merkle.audited(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_manifest(rows) if n else []))


def test_steps_of_the_manifest_lead_to_the_root(spark):
    for r in merkle.manifest(spark.createDataFrame(manifest_rows(), DOCS)).collect():
        assert merkle.fold_up(r["leaf"], [s.asDict() for s in r["steps"]]) == r["root"]


VECTORS = "vec_id long, embedding array<double>, label int, code string, part int"


def vector_rows(n=150, width=16):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, width))
    rows = [(i, (0.1 * centres[i % 6] + 0.02 * rng.normal(size=width)).tolist(), i % 4 if i % 9 else None, "c", 1) for i in range(n)]
    odd = [None, [math.nan] + [0.0] * (width - 1), [None] + [0.0] * (width - 1), [math.inf] * width, [0.0] * width, [], [0.25, -0.5], [1e300] + [0.0] * (width - 1)]
    rows += [(900 + i, v, 2, "c", 1) for i, v in enumerate(odd)]
    return [*rows, rows[3], rows[3], (None, rows[4][1], None, "c", 1), (3, rows[5][1], 1, "c", 1)]


def plain_codes(rows):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // 8) * 8
    whole = lambda v: [max(-(2**28), min(2**28, math.floor(4096 * x))) for x in v]
    kept = sorted(((r[0] is None, r[0] or 0, whole(r[1]), r[0], r[2]) for r in kept), key=lambda r: r[:3])
    vectors = [r[2] + [0] * (width - len(r[2])) for r in kept]
    size = width // 8
    parts = [[v[p * size : (p + 1) * size] for p in range(8)] for v in vectors]
    books = [[list(v[p]) for v in parts[:16]] for p in range(8)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)), k) for k, entry in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            members = defaultdict(list)
            for v in parts:
                members[nearest(p, v[p])[1]].append(v[p])
            for k, own in members.items():
                books[p][k] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    ends = [[nearest(p, v[p]) for p in range(8)] for v in parts]
    errors = [sum(d for d, _ in e) for e in ends]
    by_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        by_label[r[4]] += e
    digest = sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return [(r[3], "".join(f"{k:02x}" for _, k in e), error, by_label[r[4]], digest) for r, e, error in zip(kept, ends, errors, strict=True)]


@pytest.mark.parametrize(("cells", "together"), [(1 << 16, 4096), (3, 7)])
def test_codes_against_plain_rounds(spark, cells, together, monkeypatch):
    monkeypatch.setattr(codes, "CELLS", cells)
    monkeypatch.setattr(codes, "TOGETHER", together)
    for rows in (vector_rows(), vector_rows(9, 3), vector_rows(0, 8)):
        got = codes.compressed(spark.createDataFrame(rows, VECTORS).repartition(4)).collect()
        key = lambda r: tuple(map(str, r))
        assert sorted(map(key, got)) == sorted(map(key, plain_codes(rows)))


def test_codes_of_no_vectors_and_of_empty_ones(spark):
    none = spark.createDataFrame([(1, None, 1, "c", 1)], VECTORS)
    assert codes.compressed(none).count() == 0 and codes.compressed(none.limit(0)).count() == 0
    empty = codes.compressed(spark.createDataFrame([(1, [], 1, "c", 1), (2, [], None, "c", 1)], VECTORS)).collect()
    assert [(r["code"], r["error"], r["label_error"]) for r in empty] == [("00" * 8, 0, 0)] * 2


def test_cells_leave_out_entries_and_never_the_nearest():
    rng = np.random.default_rng(3)
    book = rng.integers(-900, 900, (16, 8))
    book[7] = book[2]
    find = codes.Nearest(book)
    parts = np.concatenate((book[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 8)), rng.integers(-2000, 2000, (500, 8))))
    index, distance = find(parts)
    every = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert find.evaluated < 0.5 * every.size
    made = find.made
    find(parts)
    assert find.made == made and find.looked_up > made


def test_cells_with_one_hash_are_told_apart():
    rng = np.random.default_rng(4)
    find = codes.Nearest(rng.integers(-900, 900, (16, 8)))
    find.mix = np.zeros(8, np.int64)
    parts = rng.integers(-900, 900, (300, 8))
    assert (find(parts)[0] == ((parts[:, None] - find.book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_contracts_of_the_three_queries(spark, folder):
    docs, vectors = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "embeddings"))
    assert plans.op12_merkle_manifest(spark, folder).columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert plans.op11_language_id(spark, folder).count() == docs.count()
    got = plans.op13_vector_codes(spark, folder)
    assert got.where(F.length("code") != 16).count() == 0 and got.count() == vectors.count()
