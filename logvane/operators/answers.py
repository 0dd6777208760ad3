"""Evaluation records with and without retrieval, and deterministic lexical metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions import text as X
from logvane.operators.embed import cosine, hashed_vector
from logvane.operators.retrieve import SEPARATOR

# what stands in for passages where a record has none
BASELINE_CONTEXT = "(answered without passages)"
EMPTY_CONTEXT = "(no passage was found)"
WITH, WITHOUT = "with_rag", "without_rag"
METRICS = ["lexical_faithfulness", "lexical_relevancy", "lexical_context_precision", "lexical_context_recall"]


def contexts(retrieved: Column) -> Column:
    """The single passages of an assembled context."""
    given = F.coalesce(retrieved, F.lit("")) != ""
    return F.when(given, F.split(retrieved, "\\Q" + SEPARATOR + "\\E")).otherwise(F.array(F.lit(EMPTY_CONTEXT)))


def evaluation_records(analyses: DataFrame, key: str = "query_id") -> DataFrame:
    """Two rows per analysis: one with its retrieved passages, one with the baseline placeholder.

    ``reference`` holds the technique ids the label rules give, never model output.
    """
    def record(condition, passages):
        return F.struct(F.lit(condition).alias("condition"), passages.alias("retrieved_contexts"))

    both = F.array(
        record(WITH, contexts(F.col("retrieved_docs"))), record(WITHOUT, F.array(F.lit(BASELINE_CONTEXT)))
    )
    return analyses.select(
        key,
        X.question(F.col("event_id"), F.col("hostname"), F.col("topic_keywords")).alias("user_input"),
        F.coalesce("threat_analysis", F.lit("")).alias("response"),
        F.col("techniques").alias("reference"),
        F.explode(both).alias("_r"),
    ).select(key, "user_input", "response", "reference", "_r.condition", "_r.retrieved_contexts")


def context_precision(passages: Column, ids: Column) -> Column:
    """Mean precision at the ranks of passages naming a reference id; 0 if none does, NULL without ids."""
    start = F.struct(F.lit(0).alias("rank"), F.lit(0).alias("hits"), F.lit(0.0).alias("total"))

    def step(state, passage):
        hit = F.exists(ids, lambda i: passage.contains(i)).cast("int")
        rank, hits = state["rank"] + 1, state["hits"] + hit
        return F.struct(rank.alias("rank"), hits.alias("hits"), (state["total"] + hit * (hits / rank)).alias("total"))

    mean = F.aggregate(passages, start, step, lambda s: F.when(s["hits"] > 0, s["total"] / s["hits"]).otherwise(F.lit(0.0)))
    return F.when(F.size(ids) > 0, mean)


def context_recall(passages: Column, ids: Column) -> Column:
    """Share of reference ids named in any passage; NULL without ids."""
    found = F.filter(ids, lambda i: F.exists(passages, lambda p: p.contains(i)))
    return F.when(F.size(ids) > 0, F.size(found) / F.size(ids))


def lexical_metrics(records: DataFrame) -> DataFrame:
    """The four metrics per record, by word and id overlap; no model judges anything."""
    passages, ids = F.col("retrieved_contexts"), F.col("reference")
    vectors = records.withColumns({
        "_q": hashed_vector(X.clean_tokens(F.col("user_input"))), "_a": hashed_vector(X.clean_tokens(F.col("response"))),
    })
    return vectors.withColumns({
        "lexical_faithfulness": X.grounding(F.col("response"), F.array_join(passages, " ")),
        "lexical_relevancy": cosine(F.col("_q"), F.col("_a")),
        "lexical_context_precision": context_precision(passages, ids),
        "lexical_context_recall": context_recall(passages, ids),
    }).drop("_q", "_a")


def compare_conditions(scored: DataFrame, metrics: list[str] = METRICS) -> DataFrame:
    """One row per metric: means with and without retrieval, their difference, and how many rows were scored.

    Always one row per metric: an empty input gives zeros with ``n_samples`` 0.
    """
    def mean(metric, condition):
        return F.round(F.coalesce(F.avg(F.when(F.col("condition") == condition, F.col(metric))), F.lit(0.0)), 4)

    summed = scored.agg(
        F.count_if(F.col("condition") == WITH).alias("n_samples"),
        *[F.struct(
            F.lit(m).alias("metric"), mean(m, WITH).alias(WITH), mean(m, WITHOUT).alias(WITHOUT),
            F.count_if((F.col("condition") == WITH) & F.col(m).isNotNull()).alias("n_scored"),
        ).alias(m) for m in metrics],
    )
    rows = summed.select("n_samples", F.explode(F.array(*metrics)).alias("r")).select("r.*", "n_samples")
    return rows.withColumn("delta", F.round(F.col(WITH) - F.col(WITHOUT), 4))


def column_means(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each column over its non-null rows, 0 where there are none, and how many there were."""
    return df.agg(
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in columns],
        *[F.count(c).alias(f"n_{c}") for c in columns],
    )
