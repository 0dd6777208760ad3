"""Tables behind the dashboard: severities, techniques, heatmap, model comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.operators.summaries import value_counts

# Severity words and their order.
SEVERITIES = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}


def severity(text: Column, words: dict[str, int] = SEVERITIES) -> Column:
    """The first severity word in the text, else NULL."""
    return F.nullif(F.regexp_extract(text, "(" + "|".join(words) + ")", 1), F.lit(""))


def severity_rank(word: Column, words: dict[str, int] = SEVERITIES) -> Column:
    rank = F.lit(None).cast("int")
    for name, value in words.items():
        rank = F.when(word == name, F.lit(value)).otherwise(rank)
    return rank


def severity_distribution(df: DataFrame, text_col: str, words: dict[str, int] = SEVERITIES) -> DataFrame:
    return value_counts(df.select(severity(F.col(text_col), words).alias("severity")), "severity")


def technique_frequency(df: DataFrame, column: str, limit: int = 12) -> DataFrame:
    return value_counts(df, column, limit)


def severity_heatmap(
    df: DataFrame, rows: str, columns: str, column_values: list, text_col: str, words: dict[str, int] = SEVERITIES
) -> DataFrame:
    """Mean severity rank by two keys, one column per given value, 0 where nothing falls."""
    ranked = df.withColumn("_rank", severity_rank(severity(F.col(text_col), words), words))
    return ranked.groupBy(rows).pivot(columns, column_values).agg(F.avg("_rank")).na.fill(0.0)


def model_comparison(report: DataFrame, metrics: list[str], models: list[str]) -> DataFrame:
    """Metrics as rows, models as columns."""
    long = report.unpivot(["model"], metrics, "metric", "value")
    return long.groupBy("metric").pivot("model", models).agg(F.first("value"))


def report_rows(analyses: DataFrame, renamed: dict[str, str], columns: list[str], order: list[str], limit: int = 20) -> DataFrame:
    """The first rows of the result table, under their display names."""
    return analyses.orderBy(*order).limit(limit).withColumnsRenamed(renamed).select(*columns)
