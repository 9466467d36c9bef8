"""The queries ``opN_<name>``, and the SQL of those that SQL can say."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm import bpe, chat, codes, jaccard, langid, line_dedup, merkle, mixing, near_vectors, repeats, topk
from tidewatch.llm import quality as quality_model
from tidewatch.llm import toxicity as toxicity_model
from tidewatch.llm.common import table


def op1_near_vectors(spark, folder):
    return near_vectors.near_groups(table(spark, folder, "embeddings"))


def op2_chat_format(spark, folder):
    return chat.chats(table(spark, folder, "conversations"))


def op3_quality(spark, folder):
    return quality_model.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_bpe(spark, folder):
    import public_tokenizers

    coded = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens",
        F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_top_k(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op6_toxicity(spark, folder):
    return toxicity_model.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_suffix_dedup(spark, folder):
    kept = repeats.remove_repeats(table(spark, folder, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return kept.select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def op8_jaccard_join(spark, folder):
    groups = jaccard.jaccard_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


def op9_mix_sources(spark, folder):
    mixed = mixing.mix_sources(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", mixing.taken().alias("taken"))


def op10_line_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.line_bitmaps(docs))
    return kept.select(
        "doc_id", "n_lines", "n_dropped",
        F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"),
    )


def op11_language_id(spark, folder):
    return langid.language_id(table(spark, folder, "documents"))


def op12_merkle_manifest(spark, folder):
    return merkle.audited(table(spark, folder, "documents"))


def op13_vector_codes(spark, folder):
    return codes.compressed(table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_near_vectors, op2_chat_format, op3_quality, op4_bpe, op5_top_k, op6_toxicity, op7_suffix_dedup,
        op8_jaccard_join, op9_mix_sources, op10_line_dedup, op11_language_id, op12_merkle_manifest, op13_vector_codes,
    )
}


def vector_codes_sql(rounds: int = codes.ROUNDS) -> str:
    """One pair of steps for each round: nearest entries, then their averages."""
    steps = ["""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (
  SELECT vec_id, label, (i - 1) // (len(e) // 8) AS p, (i - 1) % (len(e) // 8) AS j, v
  FROM (SELECT vec_id, label, e, unnest(e) AS v, generate_subscripts(e, 1) AS i FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT 16),
book0 AS (SELECT p, k, j, v FROM x JOIN first USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT vec_id, p, min(k) AS k, min(d) AS d
  FROM (SELECT *, min(d) OVER (PARTITION BY vec_id, p) AS least
        FROM (SELECT vec_id, p, k, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN book{r} c USING (p, j) GROUP BY ALL))
  WHERE d = least GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (
  SELECT p, k, j, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
  FROM x JOIN near{r} USING (vec_id, p) GROUP BY p, k, j),
book{r + 1} AS (SELECT p, k, j, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN mean{r} m USING (p, k, j))""")
    coded = f"""
coded AS (
  SELECT vec_id, string_agg('0' || substr('0123456789abcdef', CAST(k AS INTEGER) + 1, 1), '' ORDER BY p) AS code,
         CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id),
named AS (SELECT kept.label, coded.* FROM coded JOIN kept USING (vec_id))"""
    return ",".join([*steps, coded]) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, k, j)) FROM book{rounds}) AS codebooks_sha256
FROM named"""


def merkle_sql() -> str:
    """Both trees level by level, then each leaf with its steps to the root."""

    def leaf(text: str = "text") -> str:
        parts = []
        for c in ("doc_id", "source", "lang", "n_chars", text):
            value = f"CAST({c} AS VARCHAR)"
            parts.append(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({value})) || ':' || {value} END")
        return f"sha256({' || '.join(parts)})"

    def levels(name: str, key: str, below: str) -> str:
        return f"""
{name} AS (
  SELECT {key}, 0 AS level, number, n, digest FROM {below}
  UNION ALL
  SELECT {key}, level + 1, number // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY number))
  FROM {name} WHERE n > 1 GROUP BY {key}, level, number // 3),
{name}_steps AS (
  SELECT a.{key}, a.level, a.number,
         coalesce(string_agg(b.digest, '' ORDER BY b.number) FILTER (WHERE b.number < a.number), '') AS low,
         coalesce(string_agg(b.digest, '' ORDER BY b.number) FILTER (WHERE b.number > a.number), '') AS high
  FROM {name} a JOIN {name} b ON a.{key} IS NOT DISTINCT FROM b.{key} AND a.level = b.level AND a.number // 3 = b.number // 3
  WHERE a.n > 1 GROUP BY a.{key}, a.level, a.number)"""

    crc = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, CAST(3988292384 AS BIGINT)) ELSE v // 2 END))"""
    return f"""
WITH RECURSIVE changed AS (
  SELECT *, CASE WHEN xor({crc}, CAST(4294967295 AS BIGINT)) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents),
leaves AS (
  SELECT doc_id, source, {leaf()} AS digest, {leaf("changed")} AS tampered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS number, count(*) OVER (PARTITION BY source) AS n
  FROM changed),{levels("nodes", "source", "leaves")},
subroots AS (
  SELECT 0 AS top, source, digest, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS number, count(*) OVER () AS n
  FROM nodes WHERE n = 1),{levels("tops", "top", "subroots")},
steps AS (
  SELECT l.doc_id, 0 AS tree, s.level, s.low, s.high
  FROM leaves l JOIN nodes_steps s ON l.source IS NOT DISTINCT FROM s.source AND l.number // CAST(pow(3, s.level) AS BIGINT) = s.number
  UNION ALL
  SELECT l.doc_id, 1, s.level, s.low, s.high
  FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source
  JOIN tops_steps s ON r.number // CAST(pow(3, s.level) AS BIGINT) = s.number),
proofs AS (
  SELECT doc_id, string_agg(low || high, '' ORDER BY tree, level) AS proof,
         list(low || '|' || high ORDER BY tree, level) AS path FROM steps GROUP BY doc_id),
ends AS (
  SELECT l.doc_id, l.digest AS leaf, r.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
         sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_concat([tampered], coalesce(path, [])),
           lambda d, s: sha256(split_part(s, '|', 1) || d || split_part(s, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots r ON l.source IS NOT DISTINCT FROM r.source LEFT JOIN proofs p ON l.doc_id = p.doc_id)
SELECT *, folded_root = root AS verified FROM ends"""


#: From links (a, b) in both directions: all pairs that are connected.
REACH = """
reach AS (
  SELECT a AS node, b AS other FROM links
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a)"""

ORACLES = {
    "op1_near_vectors": f"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),{REACH},
counted AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
named AS (SELECT node AS vec_id, min(other) AS low FROM reach GROUP BY node)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links,
       least(e.vec_id, coalesce(low, e.vec_id)) AS component_id,
       e.vec_id <= coalesce(low, e.vec_id) AS kept
FROM embeddings e LEFT JOIN counted c ON e.vec_id = c.vec_id LEFT JOIN named m ON e.vec_id = m.vec_id""",
    "op8_jaccard_join": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
tokens AS (SELECT doc_id, unnest(s) AS token FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * c >= 80 * (x.n + y.n - c)),{REACH},
named AS (SELECT node, min(other) AS low FROM reach GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM sizes LEFT JOIN named ON node = doc_id""",
    "op5_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op10_line_dedup": """
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
gone AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(g.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), ''))
         AS kept_sha256
FROM lines LEFT JOIN gone g USING (key) GROUP BY doc_id""",
    "op12_merkle_manifest": merkle_sql(),
    "op13_vector_codes": vector_codes_sql(),
}
