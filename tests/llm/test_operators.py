"""Each operator against a plain version, over texts with every kind of trouble."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, bwt, chat, hnsw, jaccard, line_dedup, mixing, quality, repeats, topk, toxicity
from tidewatch.llm import near_vectors as N

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines int, score double"
PASSAGE = "all of these words stand in a passage that several documents share, word by word and to the end of it "


def texts():
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re") for b in ("n", "rst", "é", "x", "", "bel")]
    some = lambda n: " ".join(rng.choice(words, n))
    base = some(60)
    near = base.split()
    near[30] = "other"
    return [
        None, "", " \n\t ", "one", "ONE ", "two words", base, base, base.upper(), " ".join(near),
        PASSAGE * 2 + some(30), some(40) + "\n" + PASSAGE + "\n" + some(20), "abc " * 200, "x" * 900,
        some(3000), "日本語 テキスト <|endoftext|> é \x85 ß" * 9, "\r\nline\r\n\r\nline",
        *[f"Common line\n{some(12)}\n  common LINE  \n{i}" for i in range(12)],
    ]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), 1, 0.0) for i, t in enumerate(texts())]
    return [*found, found[6], (None, "no id at all", None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_agrees_with_the_library(docs, empty, rows):
    plain = Tokenizer.from_file(PATH)
    got = bpe.encode(docs, PATH, "doc_id", "text").collect()
    assert len(got) == len(rows) and bpe.encode(empty, PATH).count() == 0
    for r in got:
        ids = plain.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids"]) == (len(ids), " ".join(map(str, ids)))
        assert r["decoded"] == plain.decode(ids, skip_special_tokens=False)


def test_bpe_refuses_a_tokenizer_that_merges_across_white_space(docs):
    with pytest.raises(ValueError):
        bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))


def test_line_dedup_drops_lines_of_ten_documents(docs, empty, rows):
    keys = defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for r in rows:
        for line in (r[1] or "").split("\n"):
            keys[key(line)].add(r[0])
    bitmaps = line_dedup.line_bitmaps(docs)
    got = line_dedup.apply_bitmaps(docs, bitmaps).collect()
    assert len(got) == len(rows)
    for r in got:
        lines = (r["text"] or "").split("\n")
        stay = [x for x in lines if not key(x) or len(keys[key(x)]) < 10]
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert sum(r["n_dropped"] for r in got) == 24
    assert line_dedup.line_bitmaps(empty).count() == 0
    first = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs, keep_first=True)).collect()
    assert sum(r["n_dropped"] for r in first) == 23


def plain_sets(rows):
    sets = {}
    for r in rows:
        words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()
    return sets


def test_jaccard_groups(docs, empty, rows):
    sets = plain_sets(rows)
    named = [i for i in sets if i is not None]
    component = {i: i for i in named}
    for _ in named:
        for a in named:
            for b in named:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    component[a] = min(component[a], component[b])
    got = jaccard.jaccard_groups(docs).collect()
    assert len(got) == len(rows) and jaccard.jaccard_groups(empty).count() == 0
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), component.get(r["doc_id"]))


def test_an_id_with_two_texts_links_through_both(spark):
    rng = np.random.default_rng(6)
    one, two = (" ".join(f"w{x}" for x in rng.integers(0, 9000, 200)) for _ in range(2))
    near = lambda text: text + " end"
    made = [(5, one), (5, two), (6, near(two)), (7, near(one)), (8, "quite another text of some words"), (9, ""), (5, one)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 1, 0.0) for i, t in made], DOCS)
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.jaccard_groups(df).collect()}
    assert {c for (i, _), c in got.items() if i in (5, 6, 7)} == {5}
    assert got[8, 2] == 8 and got[9, 0] == 9


def test_frequent_tokens_link_through_combinations(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 3)
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in rng.integers(0, 9000, 300)]
    made = []
    for i in range(40):
        own = list(base)
        own[int(rng.integers(0, 300))] = f"edit{i}"
        made.append((i, " ".join(own), "en", "s", 1, 1, 0.0))
    got = jaccard.jaccard_groups(spark.createDataFrame(made, DOCS)).collect()
    assert {r["component_id"] for r in got} == {0}


def test_tokens_of_refilled_prefixes_open_no_long_list(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    lists = []

    def seen(docs, reps, own=jaccard.signatures):
        out = own(docs, reps)
        lists.append(out.groupBy("signature").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(jaccard, "signatures", seen)
    # Half of each set is its own, more than a prefix: all signatures are of one token.
    passage = " ".join(f"p{i}" for i in range(300))
    made = [(i, f"{passage} " + " ".join(f"w{i}x{j}" for j in range(300)), "en", "s", 1, 1, 0.0) for i in range(30)]
    made.append((30, made[0][1] + " end", "en", "s", 1, 1, 0.0))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(spark.createDataFrame(made, DOCS)).collect()}
    assert got == {i: i % 30 for i in range(31)}
    assert lists[0] <= 9


def star_of_near_copies(leaves):
    """A few copies with one edit, which all others link to; the others, with five, link to no other."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(300)]
    made = []
    for i in range(leaves + 6):
        own = list(base)
        for at in rng.choice(60, 5 if i < leaves else 1, replace=False):
            own[5 * at] = f"edit{i}x{at}"
        made.append((i, " ".join(own), "en", "s", 1, 1, 0.0))
    return made


def tables_seen(monkeypatch):
    seen = defaultdict(list)

    def cut(spark, df, purpose, own=jaccard.cut_lineage):
        out = own(spark, df, purpose)
        seen[purpose].append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut_lineage", cut)
    return seen


def test_a_group_of_near_copies_is_joined_by_its_heads(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    seen = tables_seen(monkeypatch)
    got = jaccard.jaccard_groups(spark.createDataFrame(star_of_near_copies(60), DOCS)).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(seen["open-pairs"]) <= 60


def test_refilled_prefixes_are_not_read_again_from_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 8)
    seen = tables_seen(monkeypatch)
    line = "one line that very many of all documents have in common"
    made = [(i, f"{line} " + " ".join(f"w{i}x{j}" for j in range(300)), "en", "s", 1, 1, 0.0) for i in range(60)]
    got = jaccard.jaccard_groups(spark.createDataFrame(made, DOCS)).collect()
    assert {r["component_id"] for r in got} == set(range(60))
    assert max(seen["lost-tokens"]) > 10 and sum(seen["moved-tokens"]) == 0


def test_pairs_of_long_lists_come_once(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", 6)
    monkeypatch.setattr(jaccard, "FIRST", 2)
    rng = np.random.default_rng(13)
    members = {s: np.flatnonzero(rng.random(40) < rng.choice([0.1, 0.5, 0.9])).tolist() for s in range(30)}
    component = {rep: int(rng.integers(0, 25)) for rep in range(40)}
    rows = [(s, rep, 100 + 5 * (rep % 8), len(own), component[rep]) for s, own in members.items() for rep in own]
    lists = spark.createDataFrame(rows, "signature long, rep long, n int, sets long, component long")
    got = [(r["a"], r["b"]) for r in jaccard.pairs_across(lists).collect()]
    size = {rep: 100 + 5 * (rep % 8) for rep in range(40)}
    want = {
        (a, b) for own in members.values() for a in own for b in own
        if a > b and component[a] != component[b] and 100 * min(size[a], size[b]) >= 80 * max(size[a], size[b])
    }
    assert sorted(got) == sorted(want)


def test_prefixes_share_a_signature_whenever_sets_link():
    rng = np.random.default_rng(8)
    for n in (4, 5, 17, 40, 90, 400):
        for _ in range(20):
            x = np.unique(rng.integers(-(2**62), 2**62, n))
            y = np.unique(np.concatenate((x[rng.random(len(x)) > 0.1], rng.integers(-(2**62), 2**62, n // 20))))
            common = len(np.intersect1d(x, y))
            if 100 * common < 80 * (len(x) + len(y) - common):
                continue
            often = rng.random(3 * n) < rng.choice([0.0, 0.5, 1.0])
            mark = {int(v): bool(o) for v, o in zip(np.union1d(x, y), often, strict=False)}
            own = []
            for values in (x, y):
                rare = [v for v in values.tolist() if not mark[v]]
                frequent = np.array([v for v in values.tolist() if mark[v]], np.int64)
                n = len(values)
                length = jaccard.prefix_length(n, jaccard.level(n))
                own.append({*rare[:length], *jaccard.pair_signatures(n, len(rare), frequent).tolist()})
            assert own[0] & own[1]
            assert not jaccard.too_far(jaccard.parity_bits(x), len(x), jaccard.parity_bits(y), len(y))


def test_collection_transform_sorts_all_suffixes():
    rng = np.random.default_rng(1)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 14)).astype(np.uint8)) for _ in range(50)] + [b"abab" * 9] * 2
    symbols, common = bwt.collection_bwt(strings)
    owner, begin = bwt.suffix_places(strings, symbols)
    suffixes = sorted((s[k:], i) for i, s in enumerate(strings) for k in range(len(s) + 1))
    assert [strings[o][b:] for o, b in zip(owner, begin, strict=True)] == [s for s, _ in suffixes]
    for i in range(1, len(suffixes)):
        a, b = suffixes[i - 1][0], suffixes[i][0]
        assert common[i] == next((k for k, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))


@pytest.mark.parametrize("classes", [1, 256])
def test_repeated_bytes_go(docs, empty, rows, classes, monkeypatch):
    monkeypatch.setattr(repeats, "CLASSES", classes)
    ordered = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, expected = set(), {}
    for unnamed, doc_id, text in ordered:
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(data[s : s + 100])
        expected[None if unnamed else doc_id] = bytes(np.frombuffer(data, np.uint8)[~gone])
    got = repeats.remove_repeats(docs).collect()
    assert len(got) == len(rows) and repeats.remove_repeats(empty).count() == 0
    for r in got:
        assert bytes(r["kept"]) == expected[r["doc_id"]]
        assert r["n_bytes"] == len(r["kept"]) + sum(x["end"] - x["start"] for x in r["removed"])


def test_a_shard_is_transformed_in_small_collections(monkeypatch):
    sizes = []

    def seen(strings, order, starts, own=repeats.repeated_windows):
        sizes.append(sum(map(len, strings)))
        return own(strings, order, starts)

    monkeypatch.setattr(repeats, "repeated_windows", seen)
    rng = np.random.default_rng(9)
    rows = []
    for anchor in range(1000):
        passage = rng.integers(97, 123, 150, np.uint8).tobytes()
        # The second context begins 20 bytes later and shares 31 windows with the first.
        for doc_id, context in ((2 * anchor, passage), (2 * anchor + 1, passage[20:] + b"end")):
            rows.append((anchor * 7919 % 1000, doc_id, False, doc_id, 0, 0, context))
    rng.shuffle(rows)
    names = ["anchor", "digest", "unnamed", "doc_id", "text_key", "start", "context"]
    batch = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)}).to_batches()
    got = [r for b in repeats._shard(iter(batch)) for r in b.to_pylist()]
    assert sorted((r["digest"], r["low"], r["high"]) for r in got) == [(2 * a + 1, 0, 30) for a in range(1000)]
    assert max(sizes) <= 128 << 10 and len(sizes) >= 2


def test_the_edge_of_a_common_passage_fills_no_shard(spark, monkeypatch):
    heights = []

    def seen(spark, df, purpose, cut=repeats.cut_lineage):
        out = cut(spark, df, purpose)
        if purpose == "class-strings":
            sharded = out.where("classes <= 8").groupBy("anchor").count()
            heights.append(sharded.agg(F.max("count")).first()[0] or 0)
        return out

    monkeypatch.setattr(repeats, "CLASSES", 8)
    monkeypatch.setattr(repeats, "cut_lineage", seen)
    rng = np.random.default_rng(3)
    own = lambda: bytes(rng.integers(97, 123, 150, np.uint8)).decode()
    passage = own() + own()
    made = [(i, own() + passage + own(), "en", "s", 1, 1, 0.0) for i in range(60)]
    got = repeats.remove_repeats(spark.createDataFrame(made, DOCS).repartition(3)).collect()
    for r in got:
        text = made[r["doc_id"]][1].encode()
        # A byte next to the passage may be the same in an earlier document.
        before = {made[i][1].encode() for i in range(r["doc_id"])}
        gone = np.zeros(len(text), bool)
        for s in range(len(text) - 99):
            if any(text[s : s + 100] in other for other in before):
                gone[s : s + 100] = True
        assert bytes(r["kept"]) == bytes(np.frombuffer(text, np.uint8)[~gone])
    assert len(got) == 60 and max(heights) <= 8


def test_mix_meets_its_targets(spark, docs, empty):
    many = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("w"), (F.xxhash64("id") % 40 + 41).cast("int")), " ").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 != 1, F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"),
    )
    got = mixing.mix_sources(many).toPandas()
    assert len(got) == 4000 and got["copies"].between(0, 2).all()
    for _, own in got.groupby("source", dropna=False):
        assert abs((own["copies"] * own["size"]).sum() - own["target"].iloc[0]) <= 5
    sizes = got.groupby("source", dropna=False)[["source_size", "target"]].first().sort_index(na_position="last")
    left, free = 1.5 * sizes["source_size"].sum(), dict(zip(range(len(sizes)), [(5, 2, 1)[i % 3] for i in range(len(sizes))], strict=True))
    caps, target = (2.0 * sizes["source_size"]).tolist(), {}
    while free:
        over = [i for i in free if left * free[i] / sum(free.values()) > caps[i]]
        if not over:
            target |= {i: left * w / sum(free.values()) for i, w in free.items()}
            break
        for i in over:
            target[i] = caps[i]
        left -= sum(caps[i] for i in over)
        free = {i: w for i, w in free.items() if i not in over}
    assert np.allclose(sizes["target"], [target[i] for i in range(len(sizes))])
    again = mixing.mix_sources(many.repartition(5)).toPandas()
    order = ["doc_id", "copies"]
    assert (got[order].sort_values("doc_id").values == again[order].sort_values("doc_id").values).all()
    assert mixing.mix_sources(docs).count() == docs.count() and mixing.mix_sources(empty).count() == 0


def test_no_move_and_no_swap_would_come_nearer(spark):
    rng = np.random.default_rng(11)
    sizes = {"a": [2770, 71, 16, 2], "b": rng.integers(1, 900, 40).tolist(), "c": [5] * 30, None: rng.integers(100, 3000, 7).tolist(), "d": [0, 0]}
    rows = [(s, n) for s, own in sizes.items() for n in own]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")
    docs = docs.unionByName(docs.where("doc_id < 6")).repartition(4)
    got = mixing.mix_sources(docs).toPandas()
    assert len(got) == len(rows) + 6 and got["copies"].between(0, 2).all()
    for _, own in got.groupby("source", dropna=False):
        size, copies, target = own["size"].to_numpy(), own["copies"].to_numpy(), own["target"].iloc[0]
        gap = target - (size * copies).sum()
        up, down = [0, *size[copies < 2]], [0, *size[copies > 0]]
        assert min(abs(gap - a + b) for a in up for b in down) >= abs(gap) - 1e-6


def test_mix_of_the_tables_is_near_its_targets(spark):
    got = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).toPandas()
    for _, own in got.groupby("source", dropna=False):
        off = abs((own["size"] * own["copies"]).sum() - own["target"].iloc[0])
        assert off <= max(0.01 * own["target"].iloc[0], own["size"][own["size"] > 0].min())


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(120, 8))
    near = base[:40] + 0.05 * rng.normal(size=(40, 8))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate((base, near, base[:10])))]
    odd = [[], None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [1e300] * 8, [1.0, 2.0]]
    rows += [(500 + i, v, None) for i, v in enumerate(odd)] + [rows[3], (None, rows[3][1], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows


def test_near_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 50)
    monkeypatch.setattr(N, "BLOCK", 16)
    df, rows = vectors(spark)
    good = {i: np.array(v, float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {
        i: [j for j, b in good.items() if j != i and len(a) == len(b) and N.unit(a[None])[0] @ N.unit(b[None])[0] >= 0.9]
        for i, a in good.items()
    }
    component = {i: i for i in links}
    for _ in range(20):
        for i, others in links.items():
            component[i] = min([component[i], *[component[j] for j in others]])
    got = N.near_groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == (len(links.get(i, ())), component.get(i, i))
        assert r["kept"] == (component.get(i, i) == i)
    assert N.near_groups(df.limit(0)).count() == 0


def test_near_vectors_lose_no_link_among_many_almost_near(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 1200)
    rng = np.random.default_rng(7)
    own = lambda n: N.unit(rng.normal(size=(n, 64)))
    base = N.unit(0.85**0.5 * own(2)[np.arange(2000) % 2] + 0.15**0.5 * own(2000))
    off = own(100)
    off -= (off * base[:100]).sum(axis=1, keepdims=True) * base[:100]
    points = np.concatenate((base, 0.905 * base[:100] + (1 - 0.905**2) ** 0.5 * N.unit(off)))
    near = N.unit(points) @ N.unit(points).T >= 0.9
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(points)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in N.near_groups(df).collect()}
    assert got == dict(enumerate((near.sum(axis=1) - 1).tolist()))


def test_near_vectors_through_graphs_that_pass_their_audit(spark, monkeypatch):
    monkeypatch.setattr(N, "SHARD", 400)
    monkeypatch.setattr(N, "SAMPLE", 300)
    used = []

    def seen(spark, df, purpose, cut=N.cut_lineage):
        out = cut(spark, df, purpose)
        if purpose == "recall-audits":
            used.extend(out.collect())
        return out

    monkeypatch.setattr(N, "cut_lineage", seen)
    rng = np.random.default_rng(8)
    centres = N.unit(rng.normal(size=(40, 24)))
    points = N.unit(np.repeat(centres, 25, axis=0) + 0.04 * rng.normal(size=(1000, 24)))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(points)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in N.near_groups(df).collect()}
    near = points @ points.T >= 0.9
    assert len(used) >= 3 and all(a["beam"] and a["links"] >= N.LINKS_SEEN and a["recall"] >= N.RECALL for a in used)
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * (near.sum() - 1000)
    assert all(got[i]["n_links"] <= near[i].sum() - 1 for i in got)
    assert np.mean([got[i]["component_id"] == i // 25 * 25 for i in got]) == 1.0


def test_an_audit_counts_no_link_of_a_vector_with_itself():
    rng = np.random.default_rng(8)
    points, ids = N.unit(rng.normal(size=(900, 32))), np.arange(900)
    assert N.audited(points, ids, (ids, points), 0.9) == (None, {"links": 0, "beam": 0, "recall": 0.0})


def test_graph_finds_what_brute_force_finds():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    points = N.unit(np.repeat(centres, 20, axis=0) + 0.15 * rng.normal(size=(1200, 16)))
    graph = hnsw.Graph(points, np.arange(1200))
    true = [np.flatnonzero(points @ p >= 0.9) for p in points]
    found = graph.within(points, 0.9 - 1e-4, 32)
    hits = sum(len(np.intersect1d(f, t)) for f, t in zip(found, true, strict=True))
    assert hits >= 0.97 * sum(map(len, true))


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 40)
    df, rows = vectors(spark)
    good = {i: v for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and i != 505}
    got = defaultdict(list)
    for r in topk.top_k(df.where("vec_id <> 505"), F.col("vec_id") % 50 == 0, 5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in good.items()}
    assert set(got) == {i for i in whole if i % 50 == 0}
    for q, best in got.items():
        scored = [(-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q]
        assert best == [(i, -s) for s, i in sorted(scored)[:5]]
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).where("query_id = 500").count() == 5


def labelled(spark, column):
    rng = np.random.default_rng(9)
    words = ["river", "stone", "cloud", "meadow", "lantern", "winter", "paper", "garden"]
    rows, marks = [], []
    for i in range(600):
        own = list(rng.choice(words, 40))
        bad = i % 5 == 0
        if bad and column == "toxic":
            own[int(rng.integers(0, 40))] = "scumbag"
        text = " ".join(own)
        rows.append((i, text.upper().replace(" ", "!! ") if bad and column == "quality" else text, "en", "s", 1, 1, 0.5))
        marks.append((i, int(not bad), int(bad)))
    rows += [(1000, None, None, None, None, None, None), (1001, "", None, None, None, None, None), rows[0]]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("column", ["toxic", "quality"])
def test_classifiers_on_rows_they_never_saw(spark, empty, column):
    docs, labels = labelled(spark, column)
    run = toxicity.toxicity if column == "toxic" else quality.quality
    got = run(docs, labels).toPandas()
    assert len(got) == 603 and got["score"].between(0, 1).all()
    marks = labels.toPandas().merge(got[got["held_out"]].drop_duplicates(), on="doc_id")
    assert (marks[column] == marks["predicted"]).mean() > 0.97 and len(marks) > 50
    assert run(empty, labels).count() == 0
    assert run(docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_fits_are_bounded_by_documents_not_by_ids(spark):
    from tidewatch.llm import common

    rows = [(1, "clean words", None, None, 1, 1, 0.0)] * 500 + [(i, f"text {i}", None, None, 1, 1, 0.0) for i in range(2, 900)]
    rows += [(1, f"other text {i} of this id", None, None, 1, 1, 0.0) for i in range(2000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 900)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    sample, counts = common.labelled_sample(docs, labels, "toxic", 100, 5, 0)
    held_in = [i for i in range(1, 900) if zlib.crc32(str(i).encode()) % 5]
    assert counts == {0: sum(i % 2 == 0 for i in held_in), 1: sum(i % 2 for i in held_in) + 2000 * (1 in held_in)}
    drawn = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert all(50 < n < 160 for n in drawn.values())
    assert common.sampled_texts(docs, sample).count() == sum(drawn.values())
    few, _ = common.labelled_sample(docs, labels, "toxic", 100, 5, 0, class_bytes=200)
    assert few.count() < 60
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, common.labelled_sample(docs, labels, "toxic", 100, 5, 0)[0].collect()))


def test_toxicity_draws_four_thousand_rows_a_class():
    assert toxicity.fit_toxicity.__defaults__[1] == toxicity.PER_CLASS == 4000


def test_roles_come_back_without_their_markers(spark):
    rows = []
    for c in range(120):
        for t in range(5):
            role = "user" if t % 2 == 0 else "assistant"
            text = "Where is the river?" if role == "user" else "It lies behind the meadow, beyond two long hills and a mill.\nSo go there."
            rows.append((c, t, role, text, "x"))
    rows += [rows[0], (None, 1, "user", "a", "x"), (7000, None, "user", "a", "x"), (7001, 0, "user", None, "x"), (7002, 0, "tool", "Where?", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n_turns string")
    got = {r["conv_id"]: r for r in chat.chats(turns).collect()}
    assert set(got) == {*range(120), 7001, 7002}
    right = [got[c]["roles"] == ["user", "assistant"] * 2 + ["user"] for c in range(120)]
    assert np.mean(right) > 0.95
    assert got[0]["rendered"].startswith("<|user|>\nWhere is the river?\n<|end|>\n<|assistant|>\n")
    assert chat.chats(turns.limit(0)).count() == 0


def chat_model(seed):
    rng = np.random.default_rng(seed)
    return {"start": rng.normal(size=6), "move": rng.normal(size=(6, 6)), "emit": [rng.normal(size=(6, k)) for k in chat.KINDS]}


def test_parts_are_decoded_as_the_whole_transcript():
    rng = np.random.default_rng(5)
    lines = ["User: Where is it?", "  ", "Beyond the hills.", "Assistant: so:", "a", "System: be brief", "It is a long way to go there, and longer back."]
    for seed in range(12):
        model = chat_model(seed)
        parts = ["\n".join(rng.choice(lines, rng.integers(0, 5))) for _ in range(6)]
        passages = []
        for number, text in enumerate(parts):
            own, blanks = chat.full_lines(text)
            if own:
                blanks[0] += number > 0
            passages.append(chat.passage(chat.observed(own, blanks), model) if own else None)
        seams = chat.seams(passages)
        got = [chat.pieces(t, model, before, last, i == 5, i > 0) for i, (t, (before, last)) in enumerate(zip(parts, seams, strict=True))]
        roles, rendered = chat.pieces("\n\n".join(parts), model)
        assert sum((r for r, _ in got), []) == roles
        squeezed = lambda text: re.sub("\n\n+", "\n\n", text)
        assert squeezed("".join(t for _, t in got)) == squeezed(rendered)


def test_long_conversations_and_blank_lines(spark, monkeypatch):
    rows = []
    for c in range(60):
        for t in range(600 if c == 7 else 5):
            role = "user" if t % 2 == 0 else "assistant"
            text = "Where is the river?" if role == "user" else "It lies behind the meadow, beyond two long hills.\n\nSo go there."
            rows.append((c, t, role, text, "x"))
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n_turns string")
    whole = None
    for part in (256, 7, 10_000):
        monkeypatch.setattr(chat, "PART", part)
        found = [r for r in chat.chats(turns).collect() if r["conv_id"] == 7]
        found.sort(key=lambda r: r["part"])
        assert len(found) == -(-600 // part)
        rendered = "".join(r["rendered"] for r in found)
        assert whole is None or rendered == whole
        whole = rendered
        assert sum((r["roles"] for r in found), []) == ["user", "assistant"] * 300
    assert "hills.\n\nSo go there.\n<|end|>" in whole


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    model = {"start": rng.normal(size=6), "move": rng.normal(size=(6, 6)), "emit": [rng.normal(size=(6, k)) for k in chat.KINDS]}
    seen = np.stack([rng.integers(0, k, 4) for k in chat.KINDS], axis=1)
    scores = sum(e[:, seen[:, i]].T for i, e in enumerate(model["emit"]))

    def value(path):
        return model["start"][path[0]] + sum(model["move"][a, b] for a, b in zip(path, path[1:], strict=False)) + sum(scores[i, s] for i, s in enumerate(path))

    paths = np.stack(np.meshgrid(*[range(6)] * 4), -1).reshape(-1, 4)
    assert chat.viterbi(seen, model).tolist() == max(paths.tolist(), key=value)


def test_pipeline_stages_keep_their_promises(spark, tmp_path, docs, rows):
    import corpus_pipeline as C

    _, labels = labelled(spark, "toxic")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "mixing", "bpe"]
    out = C.run(spark, str(tmp_path)).toPandas()
    current = spark.read.parquet(f"{tmp_path}/documents.parquet").select(*C.COLUMNS)
    kept = {}
    for number, (name, stage) in enumerate(C.STAGES):
        current = stage(spark, current, str(tmp_path))
        current.write.parquet(f"{tmp_path}/stage-{number}")
        current = spark.read.parquet(f"{tmp_path}/stage-{number}")
        kept[name] = current.toPandas()
    assert all(list(kept[n].columns) == list(C.COLUMNS) for n in list(kept)[:-1])
    assert len(kept["line_dedup"]) == len(kept["toxicity"])
    sets = plain_sets([(r.doc_id, r.text) for r in kept["jaccard_join"].itertuples()])
    assert all(
        a is b or 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) or not sets[a]
        for a in sets for b in sets if a == a and b == b
    )
    plain = Tokenizer.from_file(PATH)
    want = sorted(
        hashlib.sha256(" ".join(map(str, plain.encode(t or "", add_special_tokens=False).ids)).encode()).hexdigest()
        for t in kept["mixing"]["text"]
    )
    assert sorted(out["ids_sha256"]) == sorted(kept["bpe"]["ids_sha256"]) == want


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    assert {"pipeline", *(f"op{n}" for n in range(1, 14))} <= {n.split("_")[0] for n in entry.queries()}


def test_toxicity_fit_does_not_depend_on_the_slices(monkeypatch):
    texts = [f"clean note {i} on weather" if i % 3 else f"vile insult {i} at you" for i in range(300)] + ["", None]
    y = np.array([0 if i % 3 else 1 for i in range(300)] + [0, 0])
    whole = toxicity.fit_grams(texts, y, 1 / 3)
    monkeypatch.setattr(toxicity, "SLICE", 7)
    monkeypatch.setattr(toxicity, "SLICE_CHARS", 90)
    sliced = toxicity.fit_grams(texts, y, 1 / 3)
    assert (whole[0] == sliced[0]).all()
    assert np.allclose(whole[1], sliced[1], atol=1e-6) and abs(whole[2] - sliced[2]) < 1e-6


def test_toxicity_grams_of_a_very_long_text():
    text = b" " + b"".join(b"%d " % i for i in range(700_000)) + b" "
    rows, buckets = toxicity.documents_with([text], None)
    assert len(np.unique(buckets)) == len(buckets) and not rows.any()
    expected = set()
    for n, found in toxicity.gram_buckets(np.frombuffer(text, np.uint8)):
        expected |= set(np.unique(found).tolist())
    assert set(buckets.tolist()) == expected
