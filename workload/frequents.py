"""The most frequent event ids and terms by bounded counters, and what that ships instead of all distinct ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from logvane.functions import text as X
from logvane.operators import frequent, keywords
from logvane.session import materialize
from workload.raw_events import NORM_CTE, normalized
from workload.topics import TERMS_CTE, _doc_tokens

EVENT_IDS, TERMS = 15, 10_000
_FOUND: dict[tuple[str, str], frequent.FrequentItems] = {}


def frequent_event_ids(spark, sf_dir):
    return frequent.frequent_items(normalized(spark, sf_dir), F.col("event_id"), EVENT_IDS).items.select(F.col("item").alias("event_id"), "n")


def _terms(spark, sf_dir):
    return _doc_tokens(spark, sf_dir).select(F.explode(X.terms(F.col("tokens"))).alias("term"))


def _frequent_terms(spark, sf_dir):
    """Found once per session, for the terms and for their costs; both passes read what each task has counted from a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FOUND:
        counted = keywords.partial_counts(_doc_tokens(spark, sf_dir).select(F.lit(0).alias("topic"), "tokens"))
        _FOUND[key] = frequent.frequent_items(materialize(counted.drop("topic"), "task-counts"), F.col("term"), TERMS, n=F.col("n"))
    return _FOUND[key]


def frequent_terms(spark, sf_dir):
    """The 10,000 most frequent words and word pairs of all documents with their exact counts."""
    return _frequent_terms(spark, sf_dir).items.select(F.col("item").alias("term"), "n")


def frequent_term_costs(spark, sf_dir):
    """Rows that the counters shuffle beside those of a count of every term, and how many terms were counted exactly."""
    found = _frequent_terms(spark, sf_dir)
    per_task = _terms(spark, sf_dir).groupBy(F.spark_partition_id().alias("task"), "term").agg(F.count("*").alias("n"))
    return per_task.agg(F.sum("n").alias("n_rows"), F.count("*").alias("rows_of_plain_count")).select(
        "n_rows", "rows_of_plain_count", F.lit(found.shuffled).alias("rows_of_counters"), F.lit(found.survivors).alias("survivors"),
        F.lit(found.shortfall).alias("shortfall"), F.lit(found.counters).alias("counters"),
    )


QUERIES = {f.__name__: f for f in [frequent_event_ids, frequent_terms, frequent_term_costs]}

ORACLES = {
    "frequent_event_ids": f"WITH {NORM_CTE} SELECT event_id, count(*) AS n FROM norm GROUP BY 1 ORDER BY n DESC, event_id LIMIT {EVENT_IDS}",
    "frequent_terms": f"WITH {TERMS_CTE} SELECT term, count(*) AS n FROM grams GROUP BY 1 ORDER BY n DESC, term LIMIT {TERMS}",
}
