"""Exact detector metrics from scores and 0/1 labels; higher scores mean more suspicious."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.operators.running import ROWS_PER_RANGE, running_totals
from logvane.session import materialize


def scores_long(df: DataFrame, label_col: str, models: dict[str, Column | str]) -> DataFrame:
    """``model, score, label``: all models in one table, so one pass serves them all."""
    entries = [
        F.struct(F.lit(name).alias("model"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("score"))
        for name, c in models.items()
    ]
    return df.select(F.col(label_col).alias("label"), F.explode(F.array(*entries)).alias("e")).select(
        "e.model", "e.score", "label"
    )


def curve(scored: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per (model, distinct score): positives and negatives at and above it.

    Ties are folded first, so no score value can make a hot group.
    """
    by_score = scored.groupBy("model", "score").agg(
        F.sum("label").cast("bigint").alias("p"), F.sum(1 - F.col("label")).cast("bigint").alias("n")
    )
    counted = materialize(by_score, "score-counts")
    totals = counted.groupBy("model").agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"))
    return (
        running_totals(counted, ["model"], "score", ["p", "n"], rows_per_range)
        .withColumnsRenamed({"cum_p": "tp", "cum_n": "fp"})
        .join(totals, "model")
    )


def _ratio(top: Column, bottom: Column) -> Column:
    """NULL-free division: a zero denominator gives 0."""
    return F.coalesce(top / F.nullif(bottom.cast("double"), F.lit(0.0)), F.lit(0.0))


def _counts() -> list[Column]:
    return [F.col(c) for c in ["tp", "fp", "p", "n", "pos", "neg"]]


def roc_points(points: DataFrame) -> DataFrame:
    tp, fp, _, _, pos, neg = _counts()
    return points.select(
        "model", F.col("score").alias("threshold"),
        (fp / F.nullif(neg, F.lit(0))).alias("fpr"), (tp / F.nullif(pos, F.lit(0))).alias("tpr"),
    )


def pr_points(points: DataFrame) -> DataFrame:
    tp, fp, _, _, pos, _ = _counts()
    return points.select(
        "model", F.col("score").alias("threshold"),
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, pos).alias("recall"),
    )


def report(points: DataFrame, scope: str = "full_corpus", digits: int = 4) -> DataFrame:
    """One row per model: ROC-AUC, average precision, and the best-F1 operating point.

    AUC and average precision are NULL when a class is absent. Equal F1 values
    resolve to the lowest threshold.
    """
    tp, fp, p, n, pos, neg = _counts()
    f1 = _ratio(2 * tp, 2 * tp + fp + (pos - tp))
    best = F.max_by(
        F.struct(
            F.col("score").alias("threshold"), f1.alias("f1"), _ratio(tp, tp + fp).alias("precision"),
            _ratio(tp, pos).alias("recall"), _ratio(fp, neg).alias("fpr"),
            (neg - fp).alias("tn"), fp.alias("fp"), (pos - tp).alias("fn"), tp.alias("tp"),
        ),
        F.struct(f1, -F.col("score")),
    )
    # products of counts leave the bigint range on large tables
    auc_area = F.sum(n.cast("double") * (tp + tp - p).cast("double") / F.lit(2.0))
    all_pairs = F.max("pos").cast("double") * F.max("neg").cast("double")
    agg = points.groupBy("model").agg(
        (auc_area / F.nullif(all_pairs, F.lit(0.0))).alias("roc_auc"),
        (F.sum(p * _ratio(tp, tp + fp)) / F.nullif(F.max("pos").cast("double"), F.lit(0.0))).alias("pr_auc"),
        best.alias("b"),
    )
    rounded = [F.round(c, digits).alias(c) for c in ["roc_auc", "pr_auc"]]
    rounded += [F.round(f"b.{c}", digits).alias(c) for c in ["f1", "precision", "recall", "fpr"]]
    return agg.select(
        "model", *rounded, "b.threshold", "b.tn", "b.fp", "b.fn", "b.tp", F.lit(scope).alias("eval_scope")
    )


def confusion(df: DataFrame, label_col: str, flag_col: str) -> DataFrame:
    """Confusion counts of a 0/1 flag against a 0/1 label."""
    y, f = F.col(label_col) == 1, F.col(flag_col) == 1
    return df.agg(
        F.count_if(~y & ~f).alias("tn"), F.count_if(~y & f).alias("fp"),
        F.count_if(y & ~f).alias("fn"), F.count_if(y & f).alias("tp"),
    )
