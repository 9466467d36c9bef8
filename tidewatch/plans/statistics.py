"""Profiles, scaler statistics, correlation, ranking and knees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import profile as P
from tidewatch.operators import relevance as R
from tidewatch.operators import scaling as Z
from tidewatch.operators import selection as L
from tidewatch.operators.sequences import final_record
from tidewatch.plans import common as C
from tidewatch.plans.scans import FEATURES
from tidewatch.plans.sequences import _windows, windows_sql
from tidewatch.session import cut_lineage
from tidewatch.sources.tables import events, table

TOP = 6
MEASURES = ["l_quantity", "price", "l_discount", "l_tax"]
MI_FEATURES = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
PRUNED_FEATURES = [*MI_FEATURES, "quantity_copy", "a_cube", "tax_copy"]
KNN_FEATURES, NEIGHBOURS = ["value", "k"], 3


def _lineitem(spark, folder):
    """Line items with nulls, infinities and a constant column put in."""
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double"))
        .otherwise(F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_suppkey") % 50 == 0, F.lit(float("inf")))
        .when(F.col("l_suppkey") % 50 == 1, F.lit(float("-inf")))
        .otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag",
        F.lit(2.5).alias("constant"),
        F.lit(None).cast("double").alias("empty"),
    )


def profile(spark, folder):
    return P.profile(_lineitem(spark, folder))


def zero_variance(spark, folder):
    return P.zero_variance(_lineitem(spark, folder))


def imbalance_ratio(spark, folder):
    return P.imbalance_ratio(events(spark, folder), "label")


def pearson_matrix(spark, folder):
    numeric = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "constant"]
    return P.pearson_matrix(_lineitem(spark, folder), numeric).withColumn("r", F.round("r", 6))


def spearman(spark, folder):
    return P.spearman_matrix(table(spark, folder, "lineitem"), FEATURES).withColumn(
        "r", F.round("r", 6)
    )


def class_weights(spark, folder):
    declared = spark.createDataFrame([(n,) for n in (*C.EVENT_CLASSES, "absent")], "label string")
    counts = events(spark, folder).groupBy("label").agg(F.count("*").alias("n_c"))
    dense = declared.join(counts, "label", "left").select(
        "label", F.coalesce("n_c", F.lit(0)).alias("n_c")
    )
    return Z.class_weights(dense, "n_c").withColumn("weight", F.round("weight", 9))


def _measures(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_suppkey", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"),
        "l_discount", "l_tax",
    )


def _rounded(stats, *keys):
    """Squared deviations per row: the sum itself has no stable last digits."""
    return stats.select(
        *keys, "feature", "count", F.round("mean", 8).alias("mean"),
        F.round(F.col("m2") / F.col("count"), 6).alias("m2_per_row"),
    )


def scaler_fit(spark, folder):
    return _rounded(Z.fit_scaler(_measures(spark, folder), MEASURES))


def _client_stats(spark, folder):
    rows = _measures(spark, folder).withColumn("client", F.col("l_suppkey") % C.CLIENTS)
    return Z.client_stats(rows, "client", MEASURES)


def client_stats(spark, folder):
    return _rounded(_client_stats(spark, folder), "client")


def client_final_stats(spark, folder):
    """Client statistics over the last record of each training window."""
    rows = _windows(spark, folder, 2).select(
        (F.col("source") % C.CLIENTS).alias("client"),
        F.element_at(final_record(), 1).cast("double").alias("value"),
        F.element_at(final_record(), 2).cast("double").alias("k"),
    )
    stats = Z.client_stats(rows, "client", ["value", "k"])
    return stats.select(
        "client", "feature", "count",
        F.round("mean", 4).alias("mean"),
        F.round(F.col("m2") / F.col("count"), 2).alias("m2_per_row"),
    )


def scaler_combine(spark, folder):
    return _rounded(Z.combine_stats(_client_stats(spark, folder)))


def scaler_gap(spark, folder):
    pooled = Z.fit_scaler(_measures(spark, folder), MEASURES)
    gap = Z.scaler_gap(Z.combine_stats(_client_stats(spark, folder)), pooled)
    return gap.select((F.col("gap") <= 1e-9).alias("within_tolerance"))


def mutual_info(spark, folder):
    rows = table(spark, folder, "lineitem").select("l_returnflag", *MI_FEATURES)
    return R.mutual_information(rows, MI_FEATURES, "l_returnflag").withColumn(
        "mi", F.round("mi", 8)
    )


def rf_importance(spark, folder):
    return R.forest_importance(
        table(spark, folder, "lineitem"), FEATURES, "l_returnflag", trees=20, seed=C.SEED
    )


def mutual_info_knn(spark, folder):
    """What value and counter tell about the type of an event, by nearest neighbours."""
    return R.mutual_information_knn(events(spark, folder), KNN_FEATURES, "label", NEIGHBOURS).withColumn(
        "mi", F.round("mi", 9)
    )


def prune_correlated(spark, folder):
    """Which of the columns, some of them near copies, survive the pruning."""
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", *MI_FEATURES, (F.col("l_quantity") * 2 + 1).alias("quantity_copy"),
        F.pow("l_quantity", F.lit(3)).alias("a_cube"), (-F.col("l_tax")).alias("tax_copy"),
    )
    columns = PRUNED_FEATURES
    relevance = R.mutual_information(rows, columns, "l_returnflag")
    features = cut_lineage(spark, relevance, "relevance")
    return L.prune_correlated(features, P.spearman_matrix(rows, columns), 0.95).select("feature", "kept")


def select_features(spark, folder):
    """The whole selection over the train side of the block split: a row for each feature."""
    train = C.split_events(spark, folder).where("side = 'train'").select(
        "event_id", "label", "block_id", "value", "k",
        (F.col("value") + F.col("k")).alias("total"),
        (F.col("k") * 3).alias("k_copy"),
        F.lit(1.0).alias("constant"),
    )
    train = cut_lineage(spark, train, "train")
    result, _ = L.select_features(train, "label", "event_id", 0.95, 2, trees=10, seed=C.SEED)
    return result.select("feature", "candidate", "kept", "fused_rank", "selected")


def _brand_scores(spark, folder):
    return table(spark, folder, "part").groupBy(F.col("p_brand").alias("feature")).agg(
        F.count("*").alias("mi"), F.max("p_size").alias("forest")
    )


def _fused(spark, folder):
    return L.rank_fusion(_brand_scores(spark, folder), "feature", ["mi", "forest"])


def rank_fusion(spark, folder):
    return _fused(spark, folder).select(
        "feature", "mi_rank", "forest_rank", F.round("fused_score", 9).alias("fused_score"),
        "fused_rank",
    )


def top_features(spark, folder):
    return L.top_features(_fused(spark, folder), TOP).select("feature", "fused_rank")


def rank_disagreements(spark, folder):
    return L.rank_disagreements(_fused(spark, folder), "feature", TOP, "mi_rank", "forest_rank")


def knee(spark, folder):
    """The knee of the running order value by month, per priority."""
    monthly = table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("series"),
        F.date_trunc("month", "o_orderdate").alias("month"),
    ).agg(F.count("*").alias("score"))
    order = Window.partitionBy("series").orderBy("month")
    points = monthly.withColumn("index", F.row_number().over(order) - 1)
    return L.knee(points, "series", "index", "score")


QUERIES = {
    "profile": profile,
    "zero_variance": zero_variance,
    "imbalance_ratio": imbalance_ratio,
    "pearson_matrix": pearson_matrix,
    "spearman": spearman,
    "class_weights": class_weights,
    "scaler_fit": scaler_fit,
    "client_stats": client_stats,
    "client_final_stats": client_final_stats,
    "scaler_combine": scaler_combine,
    "scaler_gap": scaler_gap,
    "mutual_info": mutual_info,
    "mutual_info_knn": mutual_info_knn,
    "rf_importance": rf_importance,
    "prune_correlated": prune_correlated,
    "select_features": select_features,
    "rank_fusion": rank_fusion,
    "top_features": top_features,
    "rank_disagreements": rank_disagreements,
    "knee": knee,
}

_ITEMS = """items AS (
  SELECT l_orderkey, l_linenumber, l_quantity,
         CASE WHEN l_linenumber <> 7 THEN l_discount END AS l_discount,
         CASE WHEN l_suppkey % 50 = 0 THEN 'inf'::DOUBLE
              WHEN l_suppkey % 50 = 1 THEN '-inf'::DOUBLE ELSE l_tax END AS l_tax,
         l_returnflag, 2.5::DOUBLE AS constant, NULL::DOUBLE AS empty FROM lineitem)"""
_MEASURES = """measures AS (
  SELECT l_suppkey, l_quantity, l_extendedprice / 1000 AS price, l_discount, l_tax
  FROM lineitem)"""
_TYPES = {
    "l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "constant": "double", "empty": "double",
}


def _profile_sql():
    parts = []
    for name, kind in _TYPES.items():
        infinite = "NULL" if kind == "string" else f"count(*) FILTER (isinf({name}::DOUBLE))"
        parts.append(
            f"SELECT '{name}' AS \"column\", '{kind}' AS type, count(*) AS n_rows, "
            f"count(*) - count({name}) AS null_count, {infinite} AS infinite_count FROM items"
        )
    return C.sql(_ITEMS, query=" UNION ALL ".join(parts))


def _pairs_sql(source, columns, absolute=False, undefined=()):
    def entry(a, b):
        if a == b:
            return "max(1.0::DOUBLE)"
        if a in undefined or b in undefined:
            return "max(0.0::DOUBLE)"
        r = f"corr({a}, {b})"
        return f"round({'abs(' + r + ')' if absolute else r}, 6)"

    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {entry(a, b)} AS r FROM {source}"
        for a in columns for b in columns
    )


def _stats_sql(source, features, key=None, m=8, s=6):
    head = f"{key} AS client, " if key else ""
    tail = f" GROUP BY {key}" if key else ""
    return " UNION ALL ".join(
        f"SELECT {head}'{f}' AS feature, count(*) AS count, round(avg({f}), {m}) AS mean, "
        f"round(var_pop({f}), {s}) AS m2_per_row FROM {source}{tail}"
        for f in features
    )


_RANKS = "ranks AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}"
    for f in FEATURES
) + " FROM lineitem)"


def _mi_sql(features, source, digits):
    return " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, round(sum(n / t * ln(n * t / (b * l))), {digits}) AS mi FROM (
  SELECT count(*)::DOUBLE AS n, sum(count(*)) OVER ()::DOUBLE AS t,
         sum(count(*)) OVER (PARTITION BY {f})::DOUBLE AS b,
         sum(count(*)) OVER (PARTITION BY l_returnflag)::DOUBLE AS l
  FROM {source} GROUP BY {f}, l_returnflag)"""
        for f in features
    )


def _digamma(n):
    z = f"({n} + 10)"
    steps = " + ".join(f"1.0::DOUBLE / ({n} + {i})" for i in range(10))
    return (
        f"(ln({z}::DOUBLE) - 0.5::DOUBLE / {z} - 1.0::DOUBLE / (12 * {z}::DOUBLE ** 2) + 1.0::DOUBLE / (120 * {z}::DOUBLE ** 4)"
        f" - 1.0::DOUBLE / (252 * {z}::DOUBLE ** 6) + 1.0::DOUBLE / (240 * {z}::DOUBLE ** 8) - ({steps}))"
    )


def _knn_sql(feature, k):
    """All pairs of points: the k-th nearest of a label, and the points that are nearer."""
    terms = " - ".join(_digamma(x) for x in ("k", "n_label", "m"))
    return f"""SELECT '{feature}' AS feature, round(greatest(0.0::DOUBLE, any_value({_digamma("n")}) + avg({terms})), 9) AS mi
FROM (
  SELECT d.id, d.k, d.n_label, count(*) AS m, any_value(d.n) AS n
  FROM (
    SELECT a.event_id AS id, any_value(a.x) AS x, any_value(a.n_label) AS n_label, any_value(a.n) AS n,
           least({k}, any_value(a.n_label) - 1) AS k,
           list_sort(min(abs(b.x - a.x), {k}))[least({k}, any_value(a.n_label) - 1)] AS reach
    FROM points_{feature} a JOIN points_{feature} b ON a.label = b.label AND a.event_id <> b.event_id
    GROUP BY a.event_id) d
  JOIN points_{feature} p ON abs(p.x - d.x) < d.reach OR p.x = d.x
  GROUP BY d.id, d.k, d.n_label)"""


def _points_sql(feature):
    return f"""points_{feature} AS (
  SELECT event_id, x, label, n_label, count(*) OVER () AS n FROM (
    SELECT event_id, {feature}::DOUBLE AS x, label, count(*) OVER (PARTITION BY label) AS n_label
    FROM ev WHERE label IS NOT NULL AND isfinite({feature}::DOUBLE) AND {" AND ".join(f"isfinite({f}::DOUBLE)" for f in KNN_FEATURES)})
  WHERE n_label > 1)"""


_PRUNED = "items AS (SELECT l_returnflag, " + ", ".join(MI_FEATURES) + """,
         l_quantity * 2 + 1 AS quantity_copy, pow(l_quantity, 3) AS a_cube, -l_tax AS tax_copy FROM lineitem)"""
_PRUNED_RANKS = "ranks AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {f}) + (count(*) OVER (PARTITION BY {f}) - 1) / 2.0 AS {f}" for f in PRUNED_FEATURES
) + " FROM items)"
_FUSED = """scores AS (
  SELECT p_brand AS feature, count(*) AS mi, max(p_size) AS forest FROM part GROUP BY p_brand),
ranks AS (
  SELECT *, row_number() OVER (ORDER BY mi DESC, feature) AS mi_rank,
         row_number() OVER (ORDER BY forest DESC, feature) AS forest_rank FROM scores),
summed AS (
  SELECT *, 1.0::DOUBLE / (60 + mi_rank) + 1.0::DOUBLE / (60 + forest_rank) AS fused_score
  FROM ranks),
fused AS (
  SELECT *, row_number() OVER (ORDER BY fused_score DESC, feature) AS fused_rank FROM summed)"""

ORACLES = {
    "profile": _profile_sql(),
    "zero_variance": C.sql(_ITEMS, query=" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\" FROM items HAVING count(DISTINCT {c}) = 1" for c in _TYPES
    )),
    "imbalance_ratio": """
SELECT max(n) / min(n) AS imbalance_ratio
FROM (SELECT count(*)::DOUBLE AS n FROM events GROUP BY event_type)""",
    "pearson_matrix": C.sql(
        _ITEMS,
        "usable AS (SELECT * FROM items WHERE l_discount IS NOT NULL AND isfinite(l_tax))",
        query=_pairs_sql(
            "usable", ["l_linenumber", "l_quantity", "l_discount", "l_tax", "constant"],
            undefined=("constant",))),
    "spearman": C.sql(_RANKS, query=_pairs_sql("ranks", FEATURES, absolute=True)),
    "class_weights": """
WITH counts AS (
  SELECT label, count(event_type) AS n_c
  FROM (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error', 'absent']) AS label)
  LEFT JOIN events ON event_type = label GROUP BY label)
SELECT label, n_c, CASE WHEN n_c > 0
  THEN round((SELECT sum(n_c) FROM counts)::DOUBLE / (6 * n_c), 9) ELSE 0.0::DOUBLE END AS weight
FROM counts""",
    "scaler_fit": C.sql(_MEASURES, query=_stats_sql("measures", MEASURES)),
    "client_stats": C.sql(_MEASURES, query=_stats_sql(
        "measures", MEASURES, f"(l_suppkey % {C.CLIENTS})")),
    "client_final_stats": C.sql(
        C.EV, C.SRC, windows_sql("src", 2),
        query=_stats_sql("wins", ["value", "k"], f"(source % {C.CLIENTS})", 4, 2)),
    "scaler_combine": C.sql(_MEASURES, query=_stats_sql("measures", MEASURES)),
    "scaler_gap": C.sql(_MEASURES, *[f"""part_{f} AS (
  SELECT count(*) AS n, avg({f}) AS m, var_pop({f}) * count(*) AS m2
  FROM measures GROUP BY l_suppkey % {C.CLIENTS}),
pooled_{f} AS (
  SELECT avg({f}) AS pm, stddev_pop({f}) AS ps, (SELECT sum(n * m) / sum(n) FROM part_{f}) AS fm
  FROM measures),
both_{f} AS (
  SELECT pm, ps, fm,
         sqrt((SELECT sum(m2 + n * (m - fm) ** 2) / sum(n) FROM part_{f})) AS fs
  FROM pooled_{f})""" for f in MEASURES], query="""
SELECT greatest(max(abs(fm - pm)) / max(abs(pm)), max(abs(fs - ps)) / max(abs(ps))) <= 1e-9
       AS within_tolerance FROM (""" + " UNION ALL ".join(
        f"SELECT * FROM both_{f}" for f in MEASURES) + ")"),
    "mutual_info": _mi_sql(MI_FEATURES, "lineitem", 8),
    "mutual_info_knn": C.sql(
        C.EV, *[_points_sql(f) for f in KNN_FEATURES],
        query=" UNION ALL ".join(_knn_sql(f, NEIGHBOURS) for f in KNN_FEATURES)),
    "prune_correlated": "WITH RECURSIVE " + ", ".join([
        _PRUNED, _PRUNED_RANKS, f"mi AS ({_mi_sql(PRUNED_FEATURES, 'items', 12)})",
        f"pairs AS ({_pairs_sql('ranks', PRUNED_FEATURES, absolute=True)})", """ordered AS (
  SELECT feature, row_number() OVER (ORDER BY mi DESC, feature) AS i FROM mi),
copies AS (
  SELECT o.feature, o.i, list(p.b) FILTER (WHERE p.a <> p.b AND p.r >= 0.95) AS near
  FROM ordered o JOIN pairs p ON p.a = o.feature GROUP BY o.feature, o.i),
walk AS (
  SELECT 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS kept
  UNION ALL
  SELECT c.i, CASE WHEN len(list_intersect(kept, coalesce(near, []))) > 0 THEN kept
                   ELSE list_append(kept, c.feature) END
  FROM walk JOIN copies c ON c.i = walk.i + 1)
SELECT feature, list_contains((SELECT arg_max(kept, i) FROM walk), feature) AS kept FROM ordered"""]),
    "rank_fusion": C.sql(_FUSED, query="""
SELECT feature, mi_rank, forest_rank, round(fused_score, 9) AS fused_score, fused_rank
FROM fused"""),
    "top_features": C.sql(_FUSED, query=f"""
SELECT feature, fused_rank FROM fused WHERE fused_rank <= {TOP}"""),
    "rank_disagreements": C.sql(_FUSED, query=f"""
SELECT feature, mi_rank <= {TOP} AS in_first, forest_rank <= {TOP} AS in_second FROM fused
WHERE (mi_rank <= {TOP}) <> (forest_rank <= {TOP})"""),
    "knee": """
WITH monthly AS (
  SELECT o_orderpriority AS series, date_trunc('month', o_orderdate) AS month, count(*) AS score
  FROM orders GROUP BY 1, 2),
points AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS i FROM monthly),
ends AS (
  SELECT series, count(*) - 1 AS x1, arg_min(score, i) AS y0, arg_max(score, i) AS y1
  FROM points GROUP BY series),
reach AS (
  SELECT series, i, score, row_number() OVER (
    PARTITION BY series ORDER BY abs((y1 - y0) * i - x1 * score + x1 * y0) DESC, i) AS r
  FROM points JOIN ends USING (series))
SELECT series, i AS knee_index, score AS knee_score FROM reach WHERE r = 1""",
}
