"""Grouped counts and summaries over labelled and scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_balance(labeled: DataFrame, label_col: str = "ground_truth") -> DataFrame:
    """Rows and share in percent per class."""
    counts = labeled.groupBy(label_col).agg(F.count("*").alias("n_events"))
    total = counts.agg(F.sum("n_events")).scalar()
    return counts.withColumn("pct", F.round(F.col("n_events") * 100.0 / total, 4))


def label_breakdown(labeled: DataFrame, limit: int = 12) -> DataFrame:
    """Most frequent event ids among malicious rows, with up to three image examples."""
    per_image = (
        labeled.filter(F.col("ground_truth") == 1)
        .groupBy("event_id", "image_base").agg(F.count("*").alias("n"))
    )
    top = (
        per_image.groupBy("event_id").agg(F.sum("n").alias("n_events"))
        .orderBy(F.desc("n_events"), "event_id").limit(limit)
    )
    return top.join(first_values(per_image, "event_id", "image_base", 3, "image_examples"), "event_id", "left")


def first_values(distinct: DataFrame, by: str, column: str, n: int, name: str) -> DataFrame:
    """The ``n`` smallest of the distinct values per group; the rest is cut before it is collected."""
    order = Window.partitionBy(by).orderBy(column)
    few = distinct.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n)
    return few.groupBy(by).agg(F.array_sort(F.collect_list(column)).alias(name))


def anomaly_summary(anomalies: DataFrame, scores: list[str], host_col: str = "hostname", limit: int = 15) -> DataFrame:
    """Per event id: rows, mean of each score, distinct hosts; worst first score first."""
    first = f"avg_{scores[0]}"
    return (
        anomalies.groupBy("event_id")
        .agg(
            F.count("*").alias("n_events"),
            *[F.avg(s).alias(f"avg_{s}") for s in scores],
            F.countDistinct(host_col).alias("hosts"),
        )
        .orderBy(first, "event_id").limit(limit)
    )


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Exact counts; ``approximate`` trades them for constant-size sketches."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(c).alias(f"n_{c}") for c in columns])


def event_histogram(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n_events"))


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per non-null value, most frequent first, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts if limit is None else counts.orderBy(F.desc("n"), column).limit(limit)
