"""Dedup, caps, samples, blocks, splits and client partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.draws import draw
from tidewatch.operators import dedup, sampling, split
from tidewatch.plans import common as C
from tidewatch.sources.csv_parts import surviving_parts
from tidewatch.sources.tables import events, pooled_events, table

CAP_PARTS = 500
CAP_ROWS = 700
SAMPLE = 3000
CONTENT = ["text", "lang", "source"]


def record_hash(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", dedup.record_md5(CONTENT).alias("fingerprint")
    )


def record_hash_count(spark, folder):
    """Distinct 64-bit fingerprints, which must be as many as distinct rows."""
    prints = table(spark, folder, "documents").select(dedup.record_hash(CONTENT).alias("h"))
    return prints.groupBy("h").agg(F.count("*").alias("n")).agg(
        F.count("*").alias("n_fingerprints"), F.max(F.length("h")).alias("digits")
    )


def dedup_keep_first(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", *CONTENT)
    return dedup.deduplicate(documents, "doc_id").select(
        F.col("doc_id").alias("pos"), F.md5("text").alias("text_md5"), "lang", "source"
    )


def dedup_subset(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", *CONTENT)
    return dedup.keep_first(documents, "doc_id", ["text"]).select("doc_id", "lang", "source")


def duplicate_count(spark, folder):
    return dedup.duplicate_count(table(spark, folder, "documents"), CONTENT)


def _document_sides(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", *CONTENT)
    held_out = draw(C.SEED, "doc_id") < "4"
    return documents.where(~held_out), documents.where(held_out)


def leakage_rows(spark, folder):
    train, test = _document_sides(spark, folder)
    return dedup.leaked_rows(train, test, ["text"]).select("doc_id")


def leakage_gate(spark, folder):
    """After the keep-first dedup no fingerprint is on both sides."""
    documents = table(spark, folder, "documents").select("doc_id", *CONTENT)
    kept = dedup.keep_first(documents, "doc_id", ["text"])
    held_out = draw(C.SEED, "doc_id") < "4"
    leaked = dedup.leaked_fingerprints(kept.where(~held_out), kept.where(held_out), ["text"])
    return leaked.agg(F.count("*").alias("n_leaked"))


def union_pool(spark, folder):
    """Parts that hold some classes each, null among them, pooled again."""
    rows = events(spark, folder)
    part = F.pmod(F.xxhash64("label"), F.lit(3))
    return sampling.pool(*[rows.where(part == i) for i in range(3)]).select("event_id", "label", "value")


def _part_counts(spark, folder):
    day = F.dayofmonth("ts").cast("long")
    return table(spark, folder, "events").groupBy(
        F.col("event_type").alias("label"),
        day.alias("part_number"),
        F.concat(F.col("event_type"), day.cast("string")).alias("source_file"),
    ).agg(F.count("*").alias("n_rows"))


def cap_parts(spark, folder):
    return surviving_parts(_part_counts(spark, folder), CAP_PARTS)


def _trimmed(spark, folder):
    return sampling.trim_to_cap(
        pooled_events(spark, folder), "label", "pos", CAP_ROWS, C.SEED
    )


def cap_trim(spark, folder):
    return _trimmed(spark, folder).select("event_id", "label", "pos")


def class_counts(spark, folder):
    return sampling.class_counts(_trimmed(spark, folder), "label")


def sample_rows(spark, folder):
    return sampling.sample_rows(events(spark, folder), "event_id", SAMPLE, C.SEED).select(
        "event_id", "value"
    )


def make_blocks(spark, folder):
    return split.make_blocks(
        pooled_events(spark, folder), "label", "pos", C.BLOCK_SIZE
    ).select("event_id", "pos", "block_id")


def pooled_blocks(spark, folder):
    return C.blocked(spark, folder).select("event_id", "pos", "block_id")


def arrival_blocks(spark, folder):
    """Blocks over the unsorted arrival order, where the label changes all the time."""
    return split.make_blocks(events(spark, folder), "label", "event_id", 2).select(
        "event_id", "block_id"
    )


def _blocks(spark, folder):
    return split.block_labels(C.blocked(spark, folder), "label")


def stratified_split(spark, folder):
    blocks = _blocks(spark, folder)
    cutoffs = split.fit_block_split(blocks, "label", C.TEST_FRACTION, C.SEED)
    return split.assign_side(blocks, cutoffs, "label", C.SEED).select(
        "block_id", "label", "side"
    )


def inner_split(spark, folder):
    train = C.split_events(spark, folder).where("side = 'train'").drop("side")
    return split.inner_split(train, "label", C.TEST_FRACTION, C.SEED).select(
        "event_id", "block_id", "side"
    )


def _assigned_blocks(spark, folder):
    blocks = _blocks(spark, folder)
    cutoffs = split.fit_clients(blocks, "label", C.CLIENTS, C.ALPHA, C.SEED)
    return split.assign_clients(blocks, cutoffs, "label", C.SEED)


def dirichlet_assign(spark, folder):
    return _assigned_blocks(spark, folder).select("block_id", "label", "client_id")


def client_histogram(spark, folder):
    return split.client_histogram(_assigned_blocks(spark, folder), "label", C.CLIENTS)


def client_rows(spark, folder):
    rows = C.blocked(spark, folder)
    cutoffs = split.fit_clients(
        split.block_labels(rows, "label"), "label", C.CLIENTS, C.ALPHA, C.SEED
    )
    return split.assign_clients(rows, cutoffs, "label", C.SEED).select(
        "event_id", "block_id", "client_id"
    )


QUERIES = {
    "record_hash": record_hash,
    "record_hash_count": record_hash_count,
    "dedup_keep_first": dedup_keep_first,
    "dedup_subset": dedup_subset,
    "duplicate_count": duplicate_count,
    "leakage_rows": leakage_rows,
    "leakage_gate": leakage_gate,
    "union_pool": union_pool,
    "cap_parts": cap_parts,
    "cap_trim": cap_trim,
    "class_counts": class_counts,
    "sample_rows": sample_rows,
    "make_blocks": make_blocks,
    "pooled_blocks": pooled_blocks,
    "arrival_blocks": arrival_blocks,
    "block_labels": _blocks,
    "stratified_split": stratified_split,
    "inner_split": inner_split,
    "dirichlet_assign": dirichlet_assign,
    "client_histogram": client_histogram,
    "client_rows": client_rows,
}

_CUTS = split.dirichlet_cuts(list(C.EVENT_CLASSES), C.CLIENTS, C.ALPHA, C.SEED)
ASSIGNED = (
    "shares(label, c0, c1) AS (VALUES "
    + ", ".join(f"('{k}', {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (a, b) in _CUTS.items())
    + f"""),
placed AS (
  SELECT block_id, label,
         row_number() OVER (PARTITION BY label
                            ORDER BY md5('{C.SEED}:' || label || ':' || block_id)) - 1 AS r,
         count(*) OVER (PARTITION BY label) AS n FROM blocks),
assigned AS (
  SELECT block_id, label,
         (floor(c0 * n) <= r)::INTEGER + (floor(c1 * n) <= r)::INTEGER AS client_id
  FROM placed JOIN shares USING (label))"""
)
_TRIM = f"""drawn AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('{C.SEED}:' || pos)) AS d
  FROM pool),
trimmed AS (SELECT * FROM drawn WHERE d <= {CAP_ROWS})"""
_SIDES = f"""docs AS (SELECT *, md5('{C.SEED}:' || doc_id) < '4' AS held_out FROM documents)"""

ORACLES = {
    "record_hash": """
SELECT doc_id, md5(coalesce(length(text) || ':' || text, '∅') || '|'
                   || coalesce(length(lang) || ':' || lang, '∅') || '|'
                   || coalesce(length(source) || ':' || source, '∅')) AS fingerprint
FROM documents""",
    "record_hash_count": """
SELECT count(*) AS n_fingerprints, 16 AS digits
FROM (SELECT DISTINCT text, lang, source FROM documents)""",
    "dedup_keep_first": """
SELECT row_number() OVER (ORDER BY first_id) - 1 AS pos, md5(text) AS text_md5, lang, source
FROM (SELECT text, lang, source, min(doc_id) AS first_id FROM documents GROUP BY ALL)""",
    "dedup_subset": """
SELECT doc_id, lang, source
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents)
WHERE r = 1""",
    "duplicate_count": """
SELECT n AS n_rows, d AS n_distinct, n - d AS n_duplicates
FROM (SELECT count(*) AS n FROM documents),
     (SELECT count(*) AS d FROM (SELECT DISTINCT text, lang, source FROM documents))""",
    "leakage_rows": C.sql(_SIDES, query="""
SELECT doc_id FROM docs
WHERE held_out AND text IN (SELECT text FROM docs WHERE NOT held_out)"""),
    "leakage_gate": C.sql(_SIDES, """firsts AS (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM docs)""", query="""
SELECT count(*) AS n_leaked FROM (
  SELECT md5(text) FROM firsts WHERE r = 1 AND held_out
  INTERSECT SELECT md5(text) FROM firsts WHERE r = 1 AND NOT held_out)"""),
    "union_pool": C.sql(C.EV, query="SELECT event_id, label, value FROM ev"),
    "cap_parts": f"""
WITH parts AS (
  SELECT event_type AS label, dayofmonth(ts) AS part_number,
         event_type || dayofmonth(ts) AS source_file, count(*) AS n_rows
  FROM events GROUP BY ALL),
summed AS (
  SELECT *, coalesce(CAST(sum(n_rows) OVER (
    PARTITION BY label ORDER BY part_number
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rows_before FROM parts)
SELECT * FROM summed WHERE rows_before < {CAP_PARTS}""",
    "cap_trim": C.sql(C.EV, C.POOL, _TRIM, query="SELECT event_id, label, pos FROM trimmed"),
    "class_counts": C.sql(C.EV, C.POOL, _TRIM, query="""
SELECT label, count(*) AS n_rows FROM trimmed GROUP BY label"""),
    "sample_rows": C.sql(C.EV, query=f"""
SELECT event_id, value FROM ev ORDER BY md5('{C.SEED}:' || event_id) LIMIT {SAMPLE}"""),
    "make_blocks": C.sql(C.EV, C.POOL, query="SELECT event_id, pos, block_id FROM pool"),
    "pooled_blocks": C.sql(C.EV, C.POOL, query="SELECT event_id, pos, block_id FROM pool"),
    "arrival_blocks": C.sql(C.EV, """flagged AS (
  SELECT *, coalesce(lag(label) OVER (ORDER BY event_id) <> label, true)::INTEGER AS fresh
  FROM ev),
runs AS (SELECT *, sum(fresh) OVER (ORDER BY event_id) AS run FROM flagged),
cut AS (
  SELECT *, (row_number() OVER (PARTITION BY run ORDER BY event_id) - 1) // 2 AS part FROM runs)
""", query="SELECT event_id, dense_rank() OVER (ORDER BY run, part) - 1 AS block_id FROM cut"),
    "block_labels": C.sql(C.EV, C.POOL, query="SELECT block_id, label, n_rows FROM blocks"),
    "stratified_split": C.sql(C.EV, C.POOL, C.SPLIT,
                              query="SELECT block_id, label, side FROM split"),
    "inner_split": C.sql(
        C.EV, C.POOL, C.SPLIT,
        "outer_train AS (SELECT block_id, label FROM split WHERE side = 'train')",
        C.split_sql("outer_train", "nested", C.TEST_FRACTION, C.SEED + split.INNER_SEED_OFFSET),
        query="SELECT event_id, block_id, side FROM pool JOIN nested USING (block_id, label)"),
    "dirichlet_assign": C.sql(C.EV, C.POOL, ASSIGNED,
                              query="SELECT block_id, label, client_id FROM assigned"),
    "client_histogram": C.sql(C.EV, C.POOL, ASSIGNED, query=f"""
SELECT client_id, label, count(block_id) AS n_blocks
FROM (SELECT unnest(range({C.CLIENTS}))::INTEGER AS client_id) clients
CROSS JOIN (SELECT DISTINCT label FROM blocks) labels
LEFT JOIN assigned USING (client_id, label) GROUP BY ALL"""),
    "client_rows": C.sql(C.EV, C.POOL, ASSIGNED, query="""
SELECT event_id, block_id, client_id FROM pool JOIN assigned USING (block_id, label)"""),
}
