"""Features, simple SQL-checkable detectors, summaries and detector metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.operators import features as X
from logvane.operators import metrics as M
from logvane.operators import quantiles as Q
from logvane.operators import scores as S
from logvane.operators import summaries
from logvane.operators.normalize import one_hot_event_ids, top_event_ids
from logvane.session import materialize
from workload.raw_events import LABELED_CTE, NORM_CTE, labeled, normalized, table

CONTAMINATION = 0.05
EVENT_IDS = [1, 3, 8, 10, 11, 13]
MODEL_SCORES = {
    "if_anomaly_score": True,
    "ocsvm_anomaly_score": True,
    "ae_anomaly_score": False,
}


def event_features(spark, sf_dir):
    """Labelled events with their one-hot columns, and the scaler fitted on them."""
    events = labeled(spark, sf_dir)
    events = one_hot_event_ids(events, sorted(top_event_ids(events)))
    return events, X.fit_scaler(events, X.feature_columns(events))


def _round6(columns, names):
    return [F.round(c, 6).alias(n) for c, n in zip(columns, names)]


def zscore_features(spark, sf_dir):
    events, scaler = event_features(spark, sf_dir)
    return events.select("event_key", *_round6(X.standardized(scaler), [f"z_{c}" for c in scaler.columns]))


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def zscore_lineitem(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    scaler = X.fit_scaler(lines, LINE_FEATURES)
    return lines.select(
        "l_orderkey", "l_linenumber", *_round6(X.standardized(scaler), [f"z_{c}" for c in LINE_FEATURES])
    )


def zmax_flags(spark, sf_dir):
    """Rows whose largest |z| is in the top share, threshold inclusive."""
    lines = table(spark, sf_dir, "lineitem")
    scored = lines.withColumn("score", X.max_abs_z(X.fit_scaler(lines, LINE_FEATURES)))
    cut = Q.exact_quantile(scored, "score", 1 - CONTAMINATION)
    return (
        scored.filter(F.col("score") >= cut)
        .select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))
    )


def score_quantiles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    qs = [0.01, 0.05, 0.5, 0.95, 0.999]
    # a small ranking limit makes the bracketing rounds run on these tables too
    found = Q.exact_quantiles(lines, ["l_extendedprice", "l_quantity"], qs, direct_rows=2_000)
    rows = [(c, q, round(v, 4)) for c, values in found.items() for q, v in zip(qs, values)]
    return spark.createDataFrame(rows, "column string, q double, value double")


def describe_events(spark, sf_dir):
    stats = Q.describe(normalized(spark, sf_dir), ["event_id", "severity_value", "message_len", "granted_access"])
    return stats.select("column", "n", *[F.round(c, 4).alias(c) for c in stats.columns[2:]])


def simple_scores(spark, sf_dir):
    """Three detectors built from z-scores alone, flagged like the model-based ones, plus their union."""
    events, scaler = event_features(spark, sf_dir)
    z = X.standardized(scaler)
    size = len(z)
    scored = events.select(
        *events.columns,
        (-F.array_max(F.transform(F.array(*z), F.abs))).alias("if_anomaly_score"),
        (-sum((F.abs(c) for c in z), F.lit(0.0)) / size).alias("ocsvm_anomaly_score"),
        (sum((c * c for c in z), F.lit(0.0)) / size).alias("ae_anomaly_score"),
    )
    scored = materialize(scored, "simple-scores")
    low = {c: Q.exact_quantile(scored, c, CONTAMINATION) for c in ["if_anomaly_score", "ocsvm_anomaly_score"]}
    high = Q.exact_quantile(scored, "ae_anomaly_score", 1 - CONTAMINATION)
    flagged = scored.withColumns({
        "if_is_anomaly": (F.col("if_anomaly_score") < low["if_anomaly_score"]).cast("int"),
        "ocsvm_is_anomaly": (F.col("ocsvm_anomaly_score") < low["ocsvm_anomaly_score"]).cast("int"),
        "ae_is_anomaly": (F.col("ae_anomaly_score") >= high).cast("int"),
    })
    return flagged.withColumns({
        "is_anomaly": S.combine_flags(["if_is_anomaly", "ocsvm_is_anomaly", "ae_is_anomaly"]),
        "anomaly_score": F.col("if_anomaly_score"),
    })


FLAGS = ["if_is_anomaly", "ocsvm_is_anomaly", "ae_is_anomaly"]


def scored_events(spark, sf_dir):
    return simple_scores(spark, sf_dir).select(
        "event_key", *[F.round(c, 6).alias(c) for c in [*MODEL_SCORES, "anomaly_score"]], *FLAGS, "is_anomaly"
    )


def anomaly_rows(spark, sf_dir):
    return S.anomalies(simple_scores(spark, sf_dir)).select("event_key", "event_id", "ground_truth")


def anomaly_summary(spark, sf_dir):
    found = summaries.anomaly_summary(
        S.anomalies(simple_scores(spark, sf_dir)), ["if_anomaly_score", "ae_anomaly_score"]
    )
    return found.withColumns({c: F.round(c, 5) for c in ["avg_if_anomaly_score", "avg_ae_anomaly_score"]})


def flag_overlap(spark, sf_dir):
    return S.flag_overlap(simple_scores(spark, sf_dir), FLAGS)


def majority_flags(spark, sf_dir):
    scored = simple_scores(spark, sf_dir)
    return scored.select(
        "event_key", S.combine_flags(FLAGS, 2).alias("two_of_three"), S.combine_flags(FLAGS, 3).alias("all_three")
    )


def distinct_hosts(spark, sf_dir):
    return summaries.distinct_counts(normalized(spark, sf_dir), ["hostname", "event_id"])


def event_system_histogram(spark, sf_dir):
    return summaries.event_histogram(normalized(spark, sf_dir), ["event_id", "is_system"])


def score_attach(spark, sf_dir):
    """Scores of flagged rows joined back by event key; unflagged rows get the most benign score."""
    flagged = S.anomalies(simple_scores(spark, sf_dir))
    joined = S.attach_scores(labeled(spark, sf_dir), flagged, list(MODEL_SCORES))
    filled = S.impute_benign(joined, MODEL_SCORES)
    return filled.select("event_key", *[F.round(c, 6).alias(c) for c in MODEL_SCORES])


LEGACY_KEYS = ["timestamp", "event_id", "hostname", "process_id"]


def score_reattach(spark, sf_dir):
    """The same by a composite key that is not unique: the first flagged twin's score is inherited."""
    flagged = S.anomalies(simple_scores(spark, sf_dir))
    joined = S.reattach_scores(labeled(spark, sf_dir), flagged, LEGACY_KEYS, list(MODEL_SCORES))
    return joined.select("event_key", *[F.round(c, 6).alias(c) for c in MODEL_SCORES])


def _curve(scored, label="ground_truth"):
    models = {c: S.suspicion(c, low) for c, low in MODEL_SCORES.items()}
    return M.curve(M.scores_long(scored, label, models))


def detector_report(spark, sf_dir):
    found = M.report(_curve(simple_scores(spark, sf_dir)))
    return found.withColumn("threshold", F.round("threshold", 6))


def legacy_report(spark, sf_dir):
    """The report on rejoined and imputed scores."""
    flagged = S.anomalies(simple_scores(spark, sf_dir))
    joined = S.reattach_scores(labeled(spark, sf_dir), flagged, LEGACY_KEYS, list(MODEL_SCORES))
    found = M.report(_curve(S.impute_benign(joined, MODEL_SCORES)))
    return found.withColumn("threshold", F.round("threshold", 6))


def _toxicity(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    symbols = F.length(F.regexp_replace("text", "[A-Za-z ]", ""))
    joined = documents.join(labels, "doc_id").select(
        "toxic", (symbols / F.length("text")).alias("symbol_share"), F.length("text").alias("size")
    )
    return M.scores_long(joined, "toxic", {"symbol_share": "symbol_share", "size": "size"})


def toxicity_report(spark, sf_dir):
    found = M.report(M.curve(_toxicity(spark, sf_dir), rows_per_range=100))
    return found.withColumn("threshold", F.round("threshold", 6))


def toxicity_roc_points(spark, sf_dir):
    points = M.roc_points(M.curve(_toxicity(spark, sf_dir), rows_per_range=100))
    return points.select("model", *[F.round(c, 6).alias(c) for c in ["threshold", "fpr", "tpr"]])


def toxicity_pr_points(spark, sf_dir):
    points = M.pr_points(M.curve(_toxicity(spark, sf_dir), rows_per_range=100))
    return points.select("model", *[F.round(c, 6).alias(c) for c in ["threshold", "precision", "recall"]])


def flag_confusion(spark, sf_dir):
    return M.confusion(simple_scores(spark, sf_dir), "ground_truth", "is_anomaly")


QUERIES = {
    f.__name__: f
    for f in [
        zscore_features, zscore_lineitem, zmax_flags, score_quantiles, describe_events, scored_events, anomaly_rows,
        anomaly_summary, flag_overlap, majority_flags, distinct_hosts, event_system_histogram, score_attach,
        score_reattach, detector_report, legacy_report, toxicity_report, toxicity_roc_points, toxicity_pr_points,
        flag_confusion,
    ]
}

_COLUMNS = X.BASE_FEATURES + [f"eid_{i}" for i in EVENT_IDS]


def _source(column):
    return f"CAST(event_id = {column[4:]} AS INTEGER)" if column.startswith("eid_") else column


def _z(column, source=None):
    return f"CASE WHEN s_{column} = 0 THEN 0.0 ELSE ({source or _source(column)} - m_{column}) / s_{column} END"


def _stats(columns, source=_source):
    return ", ".join(f"avg({source(c)}) AS m_{c}, stddev_pop({source(c)}) AS s_{c}" for c in columns)


_Z_LIST = ", ".join(_z(c) for c in _COLUMNS)

SCORED_CTE = LABELED_CTE + f""",
stats AS (SELECT {_stats(_COLUMNS)} FROM norm),
zs AS (SELECT l.*, [{_Z_LIST}] AS z FROM labeled l, stats),
raw_scores AS (
  SELECT *, -list_max(list_transform(z, lambda x: abs(x))) AS if_anomaly_score,
    -list_sum(list_transform(z, lambda x: abs(x))) / {len(_COLUMNS)} AS ocsvm_anomaly_score,
    list_sum(list_transform(z, lambda x: x * x)) / {len(_COLUMNS)} AS ae_anomaly_score
  FROM zs),
cuts AS (SELECT quantile_cont(if_anomaly_score, 0.05) AS c1, quantile_cont(ocsvm_anomaly_score, 0.05) AS c2,
    quantile_cont(ae_anomaly_score, 0.95) AS c3 FROM raw_scores),
scored AS (
  SELECT *, greatest(if_is_anomaly, ocsvm_is_anomaly, ae_is_anomaly) AS is_anomaly, if_anomaly_score AS anomaly_score
  FROM (SELECT r.*, CAST(if_anomaly_score < c1 AS INTEGER) AS if_is_anomaly,
          CAST(ocsvm_anomaly_score < c2 AS INTEGER) AS ocsvm_is_anomaly,
          CAST(ae_anomaly_score >= c3 AS INTEGER) AS ae_is_anomaly FROM raw_scores r, cuts))"""

REATTACH_CTE = SCORED_CTE + """,
firsts AS (
  SELECT "timestamp", event_id, hostname, process_id, if_anomaly_score AS f1, ocsvm_anomaly_score AS f2,
    ae_anomaly_score AS f3 FROM scored WHERE is_anomaly = 1
  QUALIFY row_number() OVER (PARTITION BY "timestamp", event_id, hostname, process_id ORDER BY event_key) = 1),
rejoined AS (
  SELECT l.event_key, l.ground_truth, f1, f2, f3 FROM labeled l
  LEFT JOIN firsts f USING ("timestamp", event_id, hostname, process_id))"""


def report_sql(long_cte: str) -> str:
    """Metrics per model of ``long(model, score, y)``."""
    return f"""WITH {long_cte},
g AS (SELECT model, score, sum(y) AS p, sum(1 - y) AS n FROM long GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER t AS pos, sum(n) OVER t AS neg FROM g
      WINDOW w AS (PARTITION BY model ORDER BY score DESC), t AS (PARTITION BY model)),
f AS (SELECT *, 2 * tp / CAST(2 * tp + fp + pos - tp AS DOUBLE) AS f1 FROM c),
b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, score) = 1),
a AS (SELECT model, round(sum(n * (tp + tp - p) / 2.0) / (any_value(pos) * any_value(neg)), 4) AS roc_auc,
        round(sum(p * (tp / CAST(tp + fp AS DOUBLE))) / any_value(pos), 4) AS pr_auc FROM c GROUP BY model)
SELECT a.model, roc_auc, pr_auc, round(f1, 4) AS f1, round(tp / CAST(tp + fp AS DOUBLE), 4) AS "precision",
  round(tp / CAST(pos AS DOUBLE), 4) AS recall, round(fp / CAST(neg AS DOUBLE), 4) AS fpr,
  round(score, 6) AS threshold, CAST(neg - fp AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
  CAST(pos - tp AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp, 'full_corpus' AS eval_scope
FROM a JOIN b USING (model)"""


_TOX_LONG = """docs AS (SELECT toxic AS y, length(regexp_replace(text, '[A-Za-z ]', '', 'g')) / length(text) AS symbol_share,
    CAST(length(text) AS DOUBLE) AS size FROM documents JOIN labels USING (doc_id)),
long AS (SELECT 'symbol_share' AS model, symbol_share AS score, y FROM docs UNION ALL SELECT 'size', size, y FROM docs)"""
_TOX_CURVE = f"""WITH {_TOX_LONG},
g AS (SELECT model, score, sum(y) AS p, sum(1 - y) AS n FROM long GROUP BY ALL),
c AS (SELECT *, CAST(sum(p) OVER w AS DOUBLE) AS tp, CAST(sum(n) OVER w AS DOUBLE) AS fp, sum(p) OVER t AS pos,
        sum(n) OVER t AS neg FROM g
      WINDOW w AS (PARTITION BY model ORDER BY score DESC), t AS (PARTITION BY model))"""

_ROUNDED_SCORES = ", ".join(f"round({c}, 6) AS {c}" for c in [*MODEL_SCORES, "anomaly_score"])

ORACLES = {
    "zscore_features": f"""WITH {NORM_CTE}, stats AS (SELECT {_stats(_COLUMNS)} FROM norm)
        SELECT event_key, {", ".join(f"round({_z(c)}, 6) AS z_{c}" for c in _COLUMNS)} FROM norm, stats""",
    "zscore_lineitem": f"""WITH stats AS (SELECT {_stats(LINE_FEATURES)} FROM lineitem)
        SELECT l_orderkey, l_linenumber, {", ".join(f"round({_z(c, c)}, 6) AS z_{c}" for c in LINE_FEATURES)}
        FROM lineitem, stats""",
    "zmax_flags": f"""WITH stats AS (SELECT {_stats(LINE_FEATURES)} FROM lineitem),
        s AS (SELECT l_orderkey, l_linenumber, greatest({", ".join(f"abs({_z(c, c)})" for c in LINE_FEATURES)}) AS score
              FROM lineitem, stats)
        SELECT l_orderkey, l_linenumber, round(score, 6) AS score FROM s
        WHERE score >= (SELECT quantile_cont(score, 0.95) FROM s)""",
    "score_quantiles": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({q} AS DOUBLE) AS q, round(quantile_cont({c}, {q}), 4) AS value FROM lineitem"""
        for c in ["l_extendedprice", "l_quantity"] for q in [0.01, 0.05, 0.5, 0.95, 0.999]
    ),
    "describe_events": f"WITH {NORM_CTE} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            CAST(min({c}) AS DOUBLE) AS min, round(quantile_cont({c}, 0.25), 4) AS q25,
            round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75,
            CAST(max({c}) AS DOUBLE) AS max FROM norm"""
        for c in ["event_id", "severity_value", "message_len", "granted_access"]
    ),
    "scored_events": f"""WITH {SCORED_CTE} SELECT event_key, {_ROUNDED_SCORES}, if_is_anomaly, ocsvm_is_anomaly,
        ae_is_anomaly, is_anomaly FROM scored""",
    "anomaly_rows": f"WITH {SCORED_CTE} SELECT event_key, event_id, ground_truth FROM scored WHERE is_anomaly = 1",
    "anomaly_summary": f"""WITH {SCORED_CTE} SELECT event_id, count(*) AS n_events,
        round(avg(if_anomaly_score), 5) AS avg_if_anomaly_score, round(avg(ae_anomaly_score), 5) AS avg_ae_anomaly_score,
        count(DISTINCT hostname) AS hosts FROM scored WHERE is_anomaly = 1 GROUP BY 1
        ORDER BY avg(if_anomaly_score), event_id LIMIT 15""",
    "flag_overlap": f"""WITH {SCORED_CTE} SELECT if_is_anomaly, ocsvm_is_anomaly, ae_is_anomaly, count(*) AS n_rows
        FROM scored GROUP BY ALL""",
    "majority_flags": f"""WITH {SCORED_CTE} SELECT event_key,
        CAST(if_is_anomaly + ocsvm_is_anomaly + ae_is_anomaly >= 2 AS INTEGER) AS two_of_three,
        CAST(if_is_anomaly + ocsvm_is_anomaly + ae_is_anomaly = 3 AS INTEGER) AS all_three FROM scored""",
    "distinct_hosts": f"""WITH {NORM_CTE} SELECT count(DISTINCT hostname) AS n_hostname,
        count(DISTINCT event_id) AS n_event_id FROM norm""",
    "event_system_histogram": f"""WITH {NORM_CTE} SELECT event_id, is_system, count(*) AS n_events FROM norm GROUP BY ALL""",
    "score_attach": f"""WITH {SCORED_CTE},
        ext AS (SELECT max(if_anomaly_score) AS e1, max(ocsvm_anomaly_score) AS e2, min(ae_anomaly_score) AS e3
                FROM scored WHERE is_anomaly = 1)
        SELECT event_key, round(CASE WHEN is_anomaly = 1 THEN if_anomaly_score ELSE e1 END, 6) AS if_anomaly_score,
          round(CASE WHEN is_anomaly = 1 THEN ocsvm_anomaly_score ELSE e2 END, 6) AS ocsvm_anomaly_score,
          round(CASE WHEN is_anomaly = 1 THEN ae_anomaly_score ELSE e3 END, 6) AS ae_anomaly_score FROM scored, ext""",
    "score_reattach": f"""WITH {REATTACH_CTE} SELECT event_key, round(f1, 6) AS if_anomaly_score,
        round(f2, 6) AS ocsvm_anomaly_score, round(f3, 6) AS ae_anomaly_score FROM rejoined""",
    "detector_report": report_sql(SCORED_CTE + """,
long AS (SELECT 'if_anomaly_score' AS model, -if_anomaly_score AS score, ground_truth AS y FROM scored
  UNION ALL SELECT 'ocsvm_anomaly_score', -ocsvm_anomaly_score, ground_truth FROM scored
  UNION ALL SELECT 'ae_anomaly_score', ae_anomaly_score, ground_truth FROM scored)"""),
    "legacy_report": report_sql(REATTACH_CTE + """,
ext AS (SELECT max(f1) AS e1, max(f2) AS e2, min(f3) AS e3 FROM rejoined),
long AS (SELECT 'if_anomaly_score' AS model, -coalesce(f1, e1) AS score, ground_truth AS y FROM rejoined, ext
  UNION ALL SELECT 'ocsvm_anomaly_score', -coalesce(f2, e2), ground_truth FROM rejoined, ext
  UNION ALL SELECT 'ae_anomaly_score', coalesce(f3, e3), ground_truth FROM rejoined, ext)"""),
    "toxicity_report": report_sql(_TOX_LONG),
    "toxicity_roc_points": f"""{_TOX_CURVE} SELECT model, round(score, 6) AS threshold, round(fp / neg, 6) AS fpr,
        round(tp / pos, 6) AS tpr FROM c""",
    "toxicity_pr_points": f"""{_TOX_CURVE} SELECT model, round(score, 6) AS threshold,
        round(tp / (tp + fp), 6) AS "precision", round(tp / pos, 6) AS recall FROM c""",
    "flag_confusion": f"""WITH {SCORED_CTE} SELECT count(*) FILTER (ground_truth = 0 AND is_anomaly = 0) AS tn,
        count(*) FILTER (ground_truth = 0 AND is_anomaly = 1) AS fp,
        count(*) FILTER (ground_truth = 1 AND is_anomaly = 0) AS fn,
        count(*) FILTER (ground_truth = 1 AND is_anomaly = 1) AS tp FROM scored""",
}
