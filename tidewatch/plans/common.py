"""Shared frames of the named queries and the SQL that describes the same frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.taxonomy import taxonomy_rows
from tidewatch.operators.ordering import by_position, running_count
from tidewatch.operators.split import pooled_blocks, stratified_block_split
from tidewatch.sources.tables import events

BLOCK_SIZE = 64
TEST_FRACTION = 0.2
SEED = 0
WINDOW = 3
CLIENTS = 3
ALPHA = 0.5

# The five event types as a class domain of their own; 'view' plays the benign class.
EVENT_CLASSES = ("view", "click", "purchase", "signup", "error")


def event_class(label: str = "label"):
    return F.coalesce(
        *[F.when(F.col(label) == name, F.lit(i)) for i, name in enumerate(EVENT_CLASSES)]
    )


def event_taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(name, name, i) for i, name in enumerate(EVENT_CLASSES)],
        "leaf string, family string, class_index int",
    )


def blocked(spark: SparkSession, folder: str) -> DataFrame:
    """Events with pooled ``pos`` and ``block_id``."""
    return pooled_blocks(events(spark, folder), "label", "event_id", BLOCK_SIZE)


def split_events(spark: SparkSession, folder: str) -> DataFrame:
    return stratified_block_split(blocked(spark, folder), "label", TEST_FRACTION, SEED)


def in_source_order(df: DataFrame) -> DataFrame:
    """Events with ``pos`` inside their source, before anything is filtered out."""
    return by_position(
        df, ["source"], "event_id", {"pos": running_count(inclusive=False)}
    )


def digits(column, scale: int = 100):
    """A number list as text both engines print alike."""
    return F.array_join(
        F.transform(
            column, lambda x: F.round(x.cast("double") * scale).cast("long").cast("string")
        ),
        ",",
    )


# --- the same frames in SQL -------------------------------------------------------------------

EV = """ev AS (
  SELECT event_id, user_id AS source, event_type AS label, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""
SRC = """src AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) - 1 AS pos FROM ev)"""
CLASSED = "CASE label " + " ".join(
    f"WHEN '{name}' THEN {i}" for i, name in enumerate(EVENT_CLASSES)
) + " END"
POOL = f"""ranked AS (
  SELECT *, row_number() OVER (ORDER BY label, event_id) - 1 AS pos,
         row_number() OVER (PARTITION BY label ORDER BY event_id) - 1 AS r FROM ev),
pool AS (
  SELECT * EXCLUDE (r), dense_rank() OVER (ORDER BY label, r // {BLOCK_SIZE}) - 1 AS block_id
  FROM ranked),
blocks AS (SELECT block_id, label, count(*) AS n_rows FROM pool GROUP BY ALL)"""


def split_sql(blocks: str, name: str, fraction: float, seed: int) -> str:
    """A table of (block_id, label, side) over ``blocks``."""
    return f"""{name}_drawn AS (
  SELECT block_id, label,
         row_number() OVER (PARTITION BY label
                            ORDER BY md5('{seed}:' || label || ':' || block_id)) AS r,
         count(*) OVER (PARTITION BY label) AS n
  FROM {blocks}),
{name} AS (
  SELECT block_id, label,
         CASE WHEN r <= round_even(n * {fraction}::DOUBLE, 0) THEN 'test' ELSE 'train' END AS side
  FROM {name}_drawn)"""


SPLIT = split_sql("blocks", "split", TEST_FRACTION, SEED)
TAXONOMY = "taxonomy(leaf, family, class_index) AS (VALUES " + ", ".join(
    f"('{leaf}', '{family}', {index})" for leaf, family, index in taxonomy_rows()
) + ")"


def sql(*ctes: str, query: str) -> str:
    return f"WITH {', '.join(ctes)} {query}" if ctes else query
