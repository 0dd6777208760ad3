"""Batch enrichment of analysis rows by a pluggable analyzer."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions.text import all_filled, grounding
from logvane.operators import rules
from logvane.operators.retrieve import SEPARATOR
from logvane.session import materialize

FIELDS = [
    "evidence_quotes", "grounding_check", "threat_analysis", "mitre_technique", "remediation_steps", "severity_rating",
]
REQUIRED = FIELDS[:-1]
MIN_GROUNDING = 0.5
#: the built-in analyzer reports so many quotes, and makes its analysis of so many
QUOTES, ANALYSED = 4, 2
REMINDER = "[Use only words found in the retrieved passages.] "


def severity_hint() -> Column:
    """Severity from the rule tier an event matches and its anomaly flag."""
    return (
        F.when(rules.tier2_match(), "Critical").when(rules.tier1_match(), "High")
        .when(F.col("is_anomaly") == 1, "Medium").otherwise("Low")
    )


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0)))


def _quotes(wanted: Column, passages: Column) -> Column:
    """``rank, number, tag, quote`` of the sentences that share words with the event, those that share most first."""
    def of_passage(passage: Column, number: Column) -> Column:
        tag, body = F.substring_index(passage, "\n", 1), F.substr(passage, F.instr(F.concat(passage, F.lit("\n")), "\n") + 1)
        found = F.transform(F.split(body, r"(?<=[.!?])\s+|\n+"), lambda x: F.struct(
            (-F.size(F.array_intersect(_words(x), wanted))).alias("rank"), number.alias("number"), tag.alias("tag"), F.trim(x).alias("quote")
        ))
        return F.filter(found, lambda q: (q["rank"] < 0) & (F.length(q["quote"]) > 20))

    return F.slice(F.array_sort(F.flatten(F.transform(passages, of_passage))), 1, QUOTES)


def extract(queries: DataFrame) -> DataFrame:
    """Built-in analyzer: quotes the ``QUOTES`` passage sentences that share most words with the event.

    The first ``ANALYSED`` quotes are the analysis. Column expressions only.
    """
    kept = [c for c in queries.columns if c not in (*FIELDS, "error")]
    given = F.coalesce("retrieved_docs", F.lit("")) != ""
    none = F.array().cast("array<string>")
    out = queries.select(
        *kept, F.when(given, F.split("retrieved_docs", "\\Q" + SEPARATOR + "\\E")).otherwise(none).alias("_passages"),
        _words(F.concat_ws(" ", "anomaly_context", "topic_keywords")).alias("_wanted"),
    )
    out = out.select("*", _quotes(F.col("_wanted"), F.col("_passages")).alias("_quotes"))
    each = lambda f, n=None: F.transform(F.col("_quotes") if n is None else F.slice("_quotes", 1, n), f)
    sentence = lambda q: F.when(q["quote"].endswith("."), q["quote"]).otherwise(F.concat(q["quote"], F.lit(".")))
    technique = F.array_compact(F.transform("_passages", lambda p: F.nullif(
        F.regexp_extract(p, r"^\[MITRE_ATTACK: ([^\]]+)\]", 1), F.lit("")
    )))
    hint = F.nullif(F.col("severity_hint"), F.lit("")) if "severity_hint" in queries.columns else F.lit(None)
    fields = {
        "evidence_quotes": F.array_join(each(lambda q: F.format_string('%s "%s"', q["tag"], q["quote"])), "\n"),
        "grounding_check": F.array_join(each(lambda q, i: F.format_string("Quote %s <- %s", i + 1, q["tag"])), "\n"),
        "threat_analysis": F.array_join(each(sentence, ANALYSED), " "),
        "mitre_technique": F.coalesce(F.get(technique, F.lit(0)), F.lit("")),
        "remediation_steps": F.array_join(each(lambda q, i: F.format_string("%s. Review %s", i + 1, q["tag"])), "\n"),
        "severity_rating": F.coalesce(hint, F.lit("Low")),
    }
    return out.select(*kept, *[fields[f].alias(f) for f in FIELDS], F.lit(None).cast("string").alias("error"))


def apply_analyzer(queries: DataFrame, analyzer: Callable[[dict], dict] | None = None) -> DataFrame:
    """Call ``analyzer`` per row on the executors; a failure fills ``error`` and leaves the fields NULL.

    Without one the built-in analyzer runs, as column expressions.
    """
    if analyzer is None:
        return extract(queries)
    inputs = queries.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in queries.dtypes)
    schema += "".join(f", {f} string" for f in FIELDS) + ", error string"

    def analyse(batches):
        for batch in batches:
            results = []
            for row in batch.to_dict("records"):
                try:
                    found = analyzer(row)
                    results.append([found.get(f) for f in FIELDS] + [None])
                except Exception as exc:  # one bad row must not stop the batch
                    results.append([None] * len(FIELDS) + [f"{type(exc).__name__}: {exc}"])
            columns = pd.DataFrame(results, columns=[*FIELDS, "error"], index=batch.index, dtype=object)
            yield pd.concat([batch[inputs], columns], axis=1)

    return queries.mapInPandas(analyse, schema)


def enrich(
    queries: DataFrame, analyzer: Callable[[dict], dict] | None = None, min_grounding: float = MIN_GROUNDING,
    reminder: str = REMINDER,
) -> DataFrame:
    """Analyses with one retry for rows whose analysis is not grounded in its passages.

    Both passes are stored, so an expensive analyzer runs once per row, plus once
    per retried row. Needs ``anomaly_context, topic_keywords, retrieved_docs``.
    """
    first = materialize(apply_analyzer(queries, analyzer), "analyses")
    weak = (
        F.col("error").isNull() & (F.col("retrieved_docs") != "")
        & (grounding(F.col("threat_analysis"), F.col("retrieved_docs")) < min_grounding)
    )
    context = F.col("anomaly_context")
    retry = first.filter(weak).drop(*FIELDS, "error").withColumn("anomaly_context", F.concat(F.lit(reminder), context))
    second = materialize(apply_analyzer(retry, analyzer), "retries").withColumn(
        "anomaly_context", F.substr("anomaly_context", F.lit(len(reminder) + 1))
    )
    return first.filter(~weak).withColumn("retried", F.lit(0)).unionByName(second.withColumn("retried", F.lit(1)))


def completeness(analyses: DataFrame, required: list[str] = REQUIRED, by: list[str] | None = None) -> DataFrame:
    """Rows, complete rows and their share."""
    return analyses.select(*(by or []), all_filled(required).alias("ok")).groupBy(*(by or [])).agg(
        F.count("*").alias("n_rows"), F.sum("ok").alias("n_complete"), F.round(F.avg("ok"), 4).alias("rate")
    )
