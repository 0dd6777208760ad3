"""Selecting the worst events per topic and analysing them with retrieved passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logvane.functions import text as X
from logvane.operators import embed, enrich, retrieve, rules
from logvane.operators.density import NOISE
from logvane.session import materialize

TOPICS = 12
EVENTS_PER_TOPIC = 3


def topic_means(events: DataFrame, score: str = "anomaly_score") -> DataFrame:
    return events.groupBy("topic").agg(F.count("*").alias("n_events"), F.avg(score).alias("mean_score"))


def top_topics(events: DataFrame, n: int = TOPICS, score: str = "anomaly_score") -> DataFrame:
    """The ``n`` topics with the lowest mean score; noise is no topic."""
    return (
        topic_means(events.filter(F.col("topic") != NOISE), score).orderBy("mean_score", "topic").limit(n)
    )


def worst_events(
    events: DataFrame, n: int = EVENTS_PER_TOPIC, score: str = "anomaly_score", key: str = "event_key"
) -> DataFrame:
    """The ``n`` lowest-scored events per topic; each task cuts to n per topic before the shuffle."""
    order = Window.partitionBy("topic").orderBy(score, key)
    return events.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def analysis_queries(
    events: DataFrame, topics: int = TOPICS, per_topic: int = EVENTS_PER_TOPIC, key: str = "event_key"
) -> DataFrame:
    """One row per event to analyse, with its context and retrieval query."""
    chosen = top_topics(events, topics).select("topic")
    worst = worst_events(events.join(F.broadcast(chosen), "topic", "left_semi"), per_topic, key=key)
    return worst.select(
        F.col(key).alias("query_id"), "*", X.anomaly_context().alias("anomaly_context")
    ).withColumn("query", F.concat_ws(" ", "anomaly_context", "topic_keywords"))


def analyse_events(
    events: DataFrame, kb: DataFrame, analyzer=None, topics: int = TOPICS,
    per_topic: int = EVENTS_PER_TOPIC, k: int = 5, embedder=None,
) -> DataFrame:
    """Worst events of the lowest-scored topics, each with passages and an analysis.

    All queries are searched in one pass over the knowledge base.
    """
    chosen = rules.attribute(analysis_queries(events, topics, per_topic)).withColumn(
        "severity_hint", enrich.severity_hint()
    )
    chosen = materialize(embed.embed(chosen, "query", embedder=embedder), "queries")
    placed = retrieve.retrieve(chosen, kb, k)
    return enrich.enrich(retrieve.with_context(chosen, placed).drop("embedding"), analyzer)
