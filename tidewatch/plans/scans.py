"""Scans, projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import expressions as X
from tidewatch.functions.metadata import decode_metadata, encode_metadata
from tidewatch.functions.taxonomy import taxonomy_rows, with_family
from tidewatch.operators.ordering import position_chunk, running, running_count
from tidewatch.operators.profile import stage1_columns
from tidewatch.operators.routing import held_out_pool
from tidewatch.operators.scaling import Scaler
from tidewatch.operators.split import keep_blocks
from tidewatch.plans import common as C
from tidewatch.session import cut_lineage, run_folder
from tidewatch.sources import csv_parts, store
from tidewatch.sources.tables import events, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LEAVES = [leaf for leaf, _, _ in taxonomy_rows()]


def label_from_path(spark, folder):
    tail = F.element_at(
        F.array(F.lit(".csv"), F.lit(".pcap.csv"), F.lit(".PCAP.CSV")),
        (F.col("page_id") % 3 + 1).cast("int"),
    )
    name = F.concat(F.translate(F.regexp_replace("url", "^https?://", ""), "/", "-"), tail)
    return table(spark, folder, "pages").select(
        "page_id",
        X.label_from_file_name(name).alias("label"),
        X.part_number(name).alias("part_no"),
    )


def row_position(spark, folder):
    scan = table(spark, folder, "events").select(
        "event_id",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return running(
        scan,
        [],
        [F.col("row")],
        [F.col("source_file"), position_chunk("row")],
        {"pos": running_count(inclusive=False)},
    ).select("event_id", "pos")


def csv_scan(spark, folder):
    """Events written as CSV parts of several folders, and read back with types found in the parts."""
    root = run_folder(spark, "csv")
    rows = events(spark, folder).select("event_id", "source", "label", "value", "k")
    for i in range(3):
        part = rows.where(F.col("event_id") % 3 == i)
        part.write.option("header", True).csv(f"{root}/day{i}")
    return csv_parts.scan_parts(spark, root, with_label=False).select(
        F.col("event_id").cast("long"), F.col("source").cast("long"), "label", "value", F.col("k").cast("long"),
        F.regexp_extract("source_file", "^(day[0-9])/", 1).alias("folder"),
    )


def csv_layout(spark, folder):
    """The types of columns that are whole in one part, decimal or empty in another."""
    root = run_folder(spark, "csv")
    rows = events(spark, folder)
    half = F.col("event_id") % 2 == 0
    whole = rows.where(half).select("event_id", F.floor("value").cast("int").alias("value"), F.lit(None).cast("string").alias("label"))
    exact = rows.where(~half).select("event_id", F.col("value") + 0.25, "label")
    for name, part in (("a", whole), ("b", exact.toDF("event_id", "value", "label"))):
        part.write.option("header", True).csv(f"{root}/{name}")
    layout = csv_parts.infer_layout(spark, csv_parts.discover_parts(spark, root))
    return spark.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in layout], "column string, type string"
    )


def prepared_store(spark, folder):
    """Prepared rows stored by side and read back, with the feature list that was stored beside them."""
    path = run_folder(spark, "prepared")
    store.write_prepared(C.split_events(spark, folder).select("event_id", "side", "value", "k"), path, ["k", "value"])
    rows, features, scaled = store.read_prepared(spark, path)
    return rows.select(
        "event_id", "side", F.lit(",".join(features)).alias("features"), F.lit(scaled).alias("scaled"),
        F.col("value"),
    )


def payload_json(spark, folder):
    fields = F.struct(
        F.concat(F.lit("device-"), F.col("source").cast("string")).alias("deviceId"),
        F.col("k").alias("soilMoisture"),
    )
    payload = F.to_json(fields)
    return events(spark, folder).select(
        "event_id",
        payload.alias("payload"),
        F.get_json_object(payload, "$.soilMoisture").cast("int").alias("soil_moisture"),
    )


def held_out(spark, folder):
    rows = cut_lineage(spark, C.split_events(spark, folder), "rows")
    scaler = Scaler.fit(rows.where("side = 'train'"), ["value", "k"])
    pool = held_out_pool(
        rows.where("side = 'test'"), "source", "pos", ["value", "k"], scaler, "label"
    )
    return pool.select(
        "ref",
        "true_label",
        F.round(F.col("value").cast("double"), 4).alias("value"),
        F.round(F.col("k").cast("double"), 4).alias("k"),
    )


def _with_oddities(spark, folder):
    odd = (
        F.when(F.col("event_id") % 97 == 0, F.lit(float("inf")))
        .when(F.col("event_id") % 89 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 83 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("value"))
    )
    return events(spark, folder).withColumn("value", odd)


def finite_rows(spark, folder):
    return X.finite_rows(_with_oddities(spark, folder), ["value", "k"]).select(
        "event_id", "value", "k"
    )


def finite_counts(spark, folder):
    return X.finite_counts(_with_oddities(spark, folder), ["value", "k"])


def stage1(spark, folder):
    frame = table(spark, folder, "lineitem").withColumns(
        {"constant": F.lit(1.5), "empty": F.lit(None).cast("double")}
    )
    return stage1_columns(frame, ["l_orderkey"])


def project_features(spark, folder):
    return X.project_features(table(spark, folder, "lineitem"), FEATURES)


def _leaf_events(spark, folder):
    leaf = F.element_at(
        F.array(*[F.lit(name) for name in LEAVES]), (F.col("k") % len(LEAVES) + 1).cast("int")
    )
    return events(spark, folder).select("event_id", "k", leaf.alias("leaf_label"))


def taxonomy_map(spark, folder):
    return with_family(_leaf_events(spark, folder), "leaf_label").select(
        "event_id", "leaf_label", "family"
    )


def class_index(spark, folder):
    return with_family(_leaf_events(spark, folder), "leaf_label").select(
        "event_id", "class_index"
    )


def binary_projection(spark, folder):
    benign = F.col("k") / 100.0
    probabilities = F.array(benign, 1.0 - benign)
    return with_family(_leaf_events(spark, folder), "leaf_label").select(
        "event_id",
        X.is_malicious(F.col("class_index")).alias("malicious"),
        F.round(X.attack_score(probabilities), 6).alias("score"),
    )


def scale_apply(spark, folder):
    frame = table(spark, folder, "lineitem").select(*FEATURES)
    scaled = Scaler.fit(frame, FEATURES).transform(frame)
    return scaled.select(*[F.round(f, 6).alias(f) for f in FEATURES])


def _side(side):
    def query(spark, folder):
        return C.split_events(spark, folder).where(F.col("side") == side).select(
            "event_id", "label", "block_id"
        )

    return query


def rows_of_blocks(spark, folder):
    rows = C.blocked(spark, folder)
    short = rows.groupBy("block_id").agg(F.count("*").alias("n")).where(
        F.col("n") < C.BLOCK_SIZE
    )
    return keep_blocks(rows, short).select("event_id", "block_id")


def _metadata(spark, folder):
    rows = C.in_source_order(events(spark, folder))
    return rows.select(
        "event_id",
        F.concat(F.lit("edge"), (F.col("source") % 3).cast("string")).alias("edge"),
        F.concat(F.lit("gerät-"), F.col("source").cast("string")).alias("device"),
        F.col("pos").alias("counter"),
    ).withColumn(
        "bytes", encode_metadata(F.col("edge"), F.col("device"), F.col("counter"), F.lit("v1"))
    )


def metadata_encode(spark, folder):
    return _metadata(spark, folder).select("event_id", F.hex("bytes").alias("metadata"))


def metadata_decode(spark, folder):
    size = F.octet_length("bytes")
    damaged = (
        F.when(F.col("event_id") % 7 == 0, F.substring("bytes", F.lit(1), size - 1))
        .when(F.col("event_id") % 11 == 0, F.concat("bytes", F.unhex(F.lit("00"))))
        .when(
            F.col("event_id") % 13 == 0,
            F.concat(F.unhex(F.lit("02")), F.substring("bytes", F.lit(2), size)),
        )
        .otherwise(F.col("bytes"))
    )
    sent = _metadata(spark, folder).withColumn("damaged", damaged)
    decoded = F.col("decoded")
    return sent.withColumn("decoded", decode_metadata(F.col("damaged"))).select(
        "event_id",
        decoded["edge_id"].alias("edge_id"),
        decoded["device_id"].alias("device_id"),
        decoded["counter"].cast("long").alias("counter"),
        decoded["schema_version"].alias("schema_version"),
    )


def ceiling_note(spark, folder):
    hit = (F.col("k") % 5 == C.event_class()).cast("double")
    accuracy = events(spark, folder).groupBy("source").agg(F.avg(hit).alias("accuracy"))
    return accuracy.select(
        "source", X.near_ceiling_note(F.col("accuracy"), 0.25).alias("note")
    )


QUERIES = {
    "label_from_path": label_from_path,
    "row_position": row_position,
    "csv_scan": csv_scan,
    "csv_layout": csv_layout,
    "prepared_store": prepared_store,
    "payload_json": payload_json,
    "held_out_pool": held_out,
    "finite_rows": finite_rows,
    "finite_counts": finite_counts,
    "stage1_columns": stage1,
    "project_features": project_features,
    "taxonomy_map": taxonomy_map,
    "class_index": class_index,
    "binary_projection": binary_projection,
    "scale_apply": scale_apply,
    "train_rows": _side("train"),
    "test_rows": _side("test"),
    "rows_of_blocks": rows_of_blocks,
    "metadata_encode": metadata_encode,
    "metadata_decode": metadata_decode,
    "ceiling_note": ceiling_note,
}

_LEAF = (
    "leafed AS (SELECT event_id, k, [" + ", ".join(f"'{x}'" for x in LEAVES)
    + f"][k % {len(LEAVES)} + 1] AS leaf_label FROM ev)"
)
_ODD = """odd AS (
  SELECT event_id, k, CASE WHEN event_id % 97 = 0 THEN 'inf'::DOUBLE
    WHEN event_id % 89 = 0 THEN 'nan'::DOUBLE WHEN event_id % 83 = 0 THEN NULL
    ELSE value END AS value FROM ev)"""
_META = """meta AS (
  SELECT event_id, 'edge' || (source % 3) AS edge, 'gerät-' || source AS device, pos FROM src)"""
_SCALE = """fitted AS (
  SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(k) AS mk, stddev_pop(k) AS sk
  FROM pool JOIN split USING (block_id, label) WHERE side = 'train')"""


def _stage1_sql():
    numeric = ["l_partkey", "l_suppkey", "l_linenumber", *FEATURES]
    parts = [
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) > 1 AS kept FROM lineitem"
        for c in numeric
    ]
    dropped = ["l_orderkey", "l_returnflag", "l_linestatus", "l_shipdate", "constant", "empty"]
    parts += [f"SELECT '{c}', false" for c in dropped]
    return " UNION ALL ".join(parts)


ORACLES = {
    "label_from_path": """
WITH named AS (
  SELECT page_id, replace(regexp_replace(url, '^https?://', ''), '/', '-')
         || ['.csv', '.pcap.csv', '.PCAP.CSV'][page_id % 3 + 1] AS name FROM pages),
stems AS (SELECT page_id, name, regexp_replace(name, '(?i)(\\.pcap)?\\.csv$', '') AS stem FROM named)
SELECT page_id, rtrim(rtrim(stem, '0123456789'), '-_') AS label,
       coalesce(TRY_CAST(regexp_extract(stem, '([0-9]+)$', 1) AS BIGINT), 0) AS part_no
FROM stems""",
    "row_position": "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events",
    "csv_scan": C.sql(C.EV, query="""
SELECT event_id, source, label, value, k, 'day' || (event_id % 3) AS folder FROM ev"""),
    "csv_layout": """
SELECT * FROM (VALUES ('event_id', 'int'), ('value', 'double'), ('label', 'string')) AS t("column", type)""",
    "prepared_store": C.sql(C.EV, C.POOL, C.SPLIT, query="""
SELECT event_id, side, 'k,value' AS features, false AS scaled, value
FROM pool JOIN split USING (block_id, label)"""),
    "payload_json": C.sql(C.EV, query="""
SELECT event_id, '{"deviceId":"device-' || source || '","soilMoisture":' || k || '}' AS payload,
       k AS soil_moisture FROM ev"""),
    "held_out_pool": C.sql(C.EV, C.POOL, C.SPLIT, _SCALE, query="""
SELECT source || ':' || pos AS ref, label AS true_label,
       round(CAST((value - mv) / sv AS FLOAT)::DOUBLE, 4) AS value,
       round(CAST((k - mk) / sk AS FLOAT)::DOUBLE, 4) AS k
FROM pool JOIN split USING (block_id, label), fitted WHERE side = 'test'"""),
    "finite_rows": C.sql(C.EV, _ODD, query="SELECT event_id, value, k FROM odd WHERE isfinite(value)"),
    "finite_counts": C.sql(C.EV, _ODD, query="""
SELECT count(*) FILTER (coalesce(isfinite(value), false)) AS kept,
       count(*) FILTER (NOT coalesce(isfinite(value), false)) AS excluded FROM odd"""),
    "stage1_columns": _stage1_sql(),
    "project_features": f"SELECT {', '.join(FEATURES)} FROM lineitem",
    "taxonomy_map": C.sql(C.EV, _LEAF, C.TAXONOMY, query="""
SELECT event_id, leaf_label, family FROM leafed JOIN taxonomy ON leaf_label = leaf"""),
    "class_index": C.sql(C.EV, _LEAF, C.TAXONOMY, query="""
SELECT event_id, class_index FROM leafed JOIN taxonomy ON leaf_label = leaf"""),
    "binary_projection": C.sql(C.EV, _LEAF, C.TAXONOMY, query="""
SELECT event_id, class_index > 0 AS malicious, round(1.0::DOUBLE - k / 100.0::DOUBLE, 6) AS score
FROM leafed JOIN taxonomy ON leaf_label = leaf"""),
    "scale_apply": "WITH m AS (SELECT " + ", ".join(
        f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in FEATURES
    ) + " FROM lineitem) SELECT " + ", ".join(
        f"round(({f} - m_{f}) / s_{f}, 6) AS {f}" for f in FEATURES
    ) + " FROM lineitem, m",
    **{
        f"{side}_rows": C.sql(C.EV, C.POOL, C.SPLIT, query=f"""
SELECT event_id, label, block_id FROM pool JOIN split USING (block_id, label)
WHERE side = '{side}'""")
        for side in ("train", "test")
    },
    "rows_of_blocks": C.sql(C.EV, C.POOL, query=f"""
SELECT event_id, block_id FROM pool
WHERE block_id IN (SELECT block_id FROM blocks WHERE n_rows < {C.BLOCK_SIZE})"""),
    "metadata_encode": C.sql(C.EV, C.SRC, _META, query="""
SELECT event_id, '01' || printf('%04X', strlen(edge)) || hex(edge)
       || printf('%04X', strlen(device)) || hex(device) || printf('%016X', pos)
       || '00027631' AS metadata FROM meta"""),
    "metadata_decode": C.sql(C.EV, C.SRC, _META, query="""
SELECT event_id,
       CASE WHEN ok THEN edge END AS edge_id, CASE WHEN ok THEN device END AS device_id,
       CASE WHEN ok THEN pos END AS counter, CASE WHEN ok THEN 'v1' END AS schema_version
FROM (SELECT *, event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AS ok FROM meta)
"""),
    "ceiling_note": C.sql(C.EV, query=f"""
SELECT source, CASE WHEN a >= 0.25 THEN printf('accuracy %.4f', a)
  || ' is at or above 0.2500: read macro-F1 and the false-positive rate instead' END AS note
FROM (SELECT source, avg((k % 5 = {C.CLASSED})::INTEGER) AS a FROM ev GROUP BY source)"""),
}
