"""Grounding, evaluation records, lexical answer metrics and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.functions import text as X
from logvane.operators import answers as A
from logvane.operators import enrich, metrics, reports
from logvane.operators.retrieve import SEPARATOR
from logvane.operators.rules import attribute
from logvane.operators.summaries import value_counts
from workload import knowledge, scoring
from workload.raw_events import HITS_CTE, NORM_CTE, labeled, normalized, table
from workload.topics import hashed_cte, tokens_sql


def _exchanges(spark, sf_dir):
    """Every assistant turn with the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("documents"))
    return turns.filter(F.col("role") == "assistant").join(before, ["conv_id", "turn"])


def grounding_proxy(spark, sf_dir):
    found = _exchanges(spark, sf_dir)
    return found.select(
        "conv_id", "turn", F.round(X.grounding(F.col("text"), F.col("documents")), 6).alias("grounding")
    )


def _analyses(spark, sf_dir):
    """Exchanges as analyses: the sentences before are the passages, the words of the answer the reference ids."""
    passages = F.array_join(X.long_sentences(F.col("documents")), SEPARATOR)
    words = X.clean_tokens(F.col("text"))
    ids = F.array_sort(F.array_distinct(words))
    return _exchanges(spark, sf_dir).select(
        F.concat_ws("/", "conv_id", "turn").alias("query_id"),
        F.col("turn").alias("event_id"), F.concat(F.lit("host"), F.col("conv_id").cast("string")).alias("hostname"),
        F.col("documents").alias("topic_keywords"), F.col("text").alias("threat_analysis"),
        passages.alias("retrieved_docs"), F.when(F.col("conv_id") % 5 > 0, ids).otherwise(F.array()).alias("techniques"),
    )


def evaluation_records(spark, sf_dir):
    records = A.evaluation_records(_analyses(spark, sf_dir))
    return records.select(
        "query_id", "condition", "user_input", "response", F.array_join("reference", ",").alias("reference"),
        F.array_join("retrieved_contexts", "|").alias("contexts"),
    )


def answer_metrics(spark, sf_dir):
    scored = A.lexical_metrics(A.evaluation_records(_analyses(spark, sf_dir)))
    return scored.select("query_id", "condition", *[F.round(m, 6).alias(m) for m in A.METRICS])


def condition_comparison(spark, sf_dir):
    return A.compare_conditions(A.lexical_metrics(A.evaluation_records(_analyses(spark, sf_dir))))


def metric_means(spark, sf_dir):
    scored = A.lexical_metrics(A.evaluation_records(_analyses(spark, sf_dir))).filter(F.col("condition") == A.WITH)
    return A.column_means(scored, A.METRICS)


def event_evaluation(spark, sf_dir):
    """Analyses of the worst events, with retrieval against without."""
    analyses = knowledge.analysed_events(spark, sf_dir).filter(F.col("error").isNull())
    return A.compare_conditions(A.lexical_metrics(A.evaluation_records(analyses)))


def record_completeness(spark, sf_dir):
    """Share of events per id whose text fields are all filled."""
    return enrich.completeness(
        normalized(spark, sf_dir), ["account_name", "target_object", "message"], by=["event_id"]
    )


ORDER_WORDS = {"URGENT": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}


def severity_distribution(spark, sf_dir):
    return reports.severity_distribution(table(spark, sf_dir, "orders"), "o_orderpriority", ORDER_WORDS)


def severity_heatmap(spark, sf_dir):
    """Mean severity by order status and month."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate"))
    heat = reports.severity_heatmap(orders, "o_orderstatus", "month", list(range(1, 13)), "o_orderpriority", ORDER_WORDS)
    return heat.select("o_orderstatus", *[F.round(F.col(f"`{m}`"), 6).alias(f"m{m}") for m in range(1, 13)])


def technique_frequency(spark, sf_dir):
    """The twelve technique sets that rules attribute most often."""
    named = attribute(labeled(spark, sf_dir)).withColumn(
        "technique", F.nullif(F.array_join("techniques", ","), F.lit(""))
    )
    return reports.technique_frequency(named, "technique")


def priority_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "orders"), "o_orderpriority")


def report_rows(spark, sf_dir):
    """The first twenty orders under display names."""
    return reports.report_rows(
        table(spark, sf_dir, "orders"), {"o_orderpriority": "Severity", "o_totalprice": "Score"},
        ["o_orderkey", "Severity", "Score"], ["o_orderkey"],
    )


REPORT_METRICS = ["roc_auc", "pr_auc", "f1", "precision", "recall", "fpr"]


def model_comparison(spark, sf_dir):
    """Metrics of the simple detectors side by side."""
    found = metrics.report(scoring._curve(scoring.simple_scores(spark, sf_dir)))
    return reports.model_comparison(found, REPORT_METRICS, list(scoring.MODEL_SCORES))


QUERIES = {
    f.__name__: f
    for f in [
        grounding_proxy, evaluation_records, answer_metrics, condition_comparison, metric_means, event_evaluation,
        record_completeness, severity_distribution, severity_heatmap, technique_frequency, priority_counts,
        report_rows, model_comparison,
    ]
}

_SENTENCES = "list_filter(list_transform(string_split({}, '.'), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda s: length(s) > 20)"
_EXCHANGES = """ex AS (SELECT a.conv_id, a.turn, a.text, b.text AS documents FROM conversations a
  JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant')"""


def grounding_sql(text: str, documents: str) -> str:
    sentences = _SENTENCES.format(text)
    grounded = (
        f"list_filter({sentences}, lambda s: len(list_filter(regexp_split_to_array(lower(s), '\\s+'), "
        f"lambda w: length(w) > 5 AND contains(lower({documents}), w))) > 0)"
    )
    return f"CASE WHEN len({sentences}) > 0 THEN len({grounded}) / CAST(len({sentences}) AS DOUBLE) ELSE 0.0 END"


_RECORDS = f"""{_EXCHANGES},
an AS (SELECT conv_id || '/' || turn AS query_id, 'Analyse this security anomaly: EventID ' || turn || ' on host host' ||
    conv_id || '. Topic keywords: ' || documents || '.' AS user_input, text AS response,
    {_SENTENCES.format('documents')} AS passages,
    CASE WHEN conv_id % 5 > 0 THEN list_sort(list_distinct({tokens_sql('text')})) ELSE [] END AS ids FROM ex),
rec AS (SELECT query_id, 'with_rag' AS condition, user_input, response, ids,
    CASE WHEN len(passages) > 0 THEN passages ELSE ['{A.EMPTY_CONTEXT}'] END AS contexts FROM an
  UNION ALL SELECT query_id, 'without_rag', user_input, response, ids, ['{A.BASELINE_CONTEXT}'] FROM an)"""

_METRICS = f"""{_RECORDS},{hashed_cte('an', 'query_id', 'user_input', 64, 'qv')},{hashed_cte('an', 'query_id', 'response', 64, 'av')},
hit AS (SELECT query_id, condition, u.r, CAST(len(list_filter(ids, lambda i: contains(u.c, i))) > 0 AS INTEGER) AS rel
  FROM rec, LATERAL (SELECT unnest(contexts) AS c, unnest(generate_series(1, len(contexts))) AS r) u),
cum AS (SELECT *, sum(rel) OVER (PARTITION BY query_id, condition ORDER BY r) AS hits FROM hit),
prec AS (SELECT query_id, condition, coalesce(sum(rel * hits / CAST(r AS DOUBLE)) / nullif(sum(rel), 0), 0.0) AS p
  FROM cum GROUP BY ALL),
m AS (SELECT query_id, condition,
    {grounding_sql('response', "array_to_string(contexts, ' ')")} AS lexical_faithfulness,
    list_dot_product(qv.v, av.v) AS lexical_relevancy,
    CASE WHEN len(ids) > 0 THEN p END AS lexical_context_precision,
    CASE WHEN len(ids) > 0 THEN len(list_filter(ids, lambda i: len(list_filter(contexts, lambda c: contains(c, i))) > 0))
      / CAST(len(ids) AS DOUBLE) END AS lexical_context_recall
  FROM rec JOIN prec USING (query_id, condition) JOIN qv USING (query_id) JOIN av USING (query_id))"""

_COMPARED = " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, round(coalesce(avg({m}) FILTER (condition = 'with_rag'), 0), 4) AS with_rag,
        round(coalesce(avg({m}) FILTER (condition = 'without_rag'), 0), 4) AS without_rag,
        count({m}) FILTER (condition = 'with_rag') AS n_scored,
        count(*) FILTER (condition = 'with_rag') AS n_samples FROM m"""
    for m in A.METRICS
)
_RANK = "CASE regexp_extract(o_orderpriority, '(URGENT|HIGH|MEDIUM|LOW)', 1) WHEN 'URGENT' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END"

ORACLES = {
    "grounding_proxy": f"""WITH {_EXCHANGES} SELECT conv_id, turn, round({grounding_sql('text', 'documents')}, 6) AS grounding
        FROM ex""",
    "evaluation_records": f"""WITH {_RECORDS} SELECT query_id, condition, user_input, response,
        array_to_string(ids, ',') AS reference,
        array_to_string(contexts, '|') AS contexts FROM rec""",
    "answer_metrics": f"WITH {_METRICS} SELECT query_id, condition, "
        + ", ".join(f"round({m}, 6) AS {m}" for m in A.METRICS) + " FROM m",
    "condition_comparison": f"WITH {_METRICS} SELECT *, round(with_rag - without_rag, 4) AS delta FROM ({_COMPARED})",
    "metric_means": f"WITH {_METRICS} SELECT "
        + ", ".join(f"round(coalesce(avg({m}), 0), 4) AS {m}, count({m}) AS n_{m}" for m in A.METRICS)
        + " FROM m WHERE condition = 'with_rag'",
    "record_completeness": f"""WITH {NORM_CTE}, c AS (SELECT event_id, CASE WHEN coalesce(account_name, '') <> '' AND
        target_object <> '' AND message <> '' THEN 1 ELSE 0 END AS ok FROM norm)
        SELECT event_id, count(*) AS n_rows, CAST(sum(ok) AS BIGINT) AS n_complete, round(avg(ok), 4) AS rate
        FROM c GROUP BY event_id""",
    "severity_distribution": """SELECT severity, count(*) AS n FROM (SELECT regexp_extract(o_orderpriority,
        '(URGENT|HIGH|MEDIUM|LOW)', 1) AS severity FROM orders) WHERE severity <> '' GROUP BY 1""",
    "severity_heatmap": "SELECT o_orderstatus, " + ", ".join(
        f"round(coalesce(avg(CASE WHEN month(o_orderdate) = {m} THEN {_RANK} END), 0), 6) AS m{m}" for m in range(1, 13)
    ) + " FROM orders GROUP BY 1",
    "technique_frequency": f"""WITH {HITS_CTE}, t AS (SELECT event_key, string_agg(technique, ',' ORDER BY technique) AS technique
        FROM (SELECT DISTINCT event_key, technique FROM hits WHERE technique IS NOT NULL) GROUP BY 1)
        SELECT technique, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, technique LIMIT 12""",
    "priority_counts": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "report_rows": """SELECT o_orderkey, o_orderpriority AS "Severity", o_totalprice AS "Score" FROM orders
        ORDER BY o_orderkey LIMIT 20""",
    "model_comparison": f"""WITH r AS ({scoring.ORACLES['detector_report']}),
        l AS (UNPIVOT (SELECT model, {", ".join(f'"{c}"' for c in REPORT_METRICS)} FROM r)
              ON {", ".join(f'"{c}"' for c in REPORT_METRICS)} INTO NAME metric VALUE value)
        SELECT metric, """ + ", ".join(f"max(value) FILTER (model = '{c}') AS {c}" for c in scoring.MODEL_SCORES)
        + " FROM l GROUP BY metric",
}
