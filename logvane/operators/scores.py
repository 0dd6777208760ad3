"""Attaching, imputing, flipping and combining detector scores and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_scores(labeled: DataFrame, scored: DataFrame, columns: list[str], key: str = "event_key") -> DataFrame:
    """Left join of score columns by the event key."""
    return labeled.join(scored.select(key, *columns), key, "left")


def reattach_scores(
    labeled: DataFrame, scored: DataFrame, keys: list[str], columns: list[str], first_by: str = "event_key"
) -> DataFrame:
    """Left join on a key that may repeat: the first scored row of a key (by ``first_by``) serves them all.

    The right side is folded to one row per key before the join, so a hot key
    costs one row there and cannot multiply rows. Missing keys match each other.
    """
    keys = [k for k in keys if k in labeled.columns and k in scored.columns]
    right = (
        scored.groupBy(*[F.col(k).alias(f"_{k}") for k in keys])
        .agg(F.min_by(F.struct(*columns), first_by).alias("_first"))
    )
    same = reduce(Column.__and__, [labeled[k].eqNullSafe(right[f"_{k}"]) for k in keys])
    joined = labeled.join(right, same, "left")
    return joined.select(*labeled.columns, *[F.col(f"_first.{c}").alias(c) for c in columns])


def impute_benign(df: DataFrame, lower_is_worse: dict[str, bool]) -> DataFrame:
    """Fill missing scores with the most benign value seen for that score."""
    extremes = df.agg(
        F.struct(*[(F.max(c) if low else F.min(c)).alias(c) for c, low in lower_is_worse.items()])
    ).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), extremes[c], F.lit(0.0)) for c in lower_is_worse})


def suspicion(column: str, lower_is_worse: bool) -> Column:
    """Score turned so that higher means more suspicious."""
    return -F.col(column) if lower_is_worse else F.col(column)


def combine_flags(columns: list[str], at_least: int = 1) -> Column:
    """1 when at least that many of the 0/1 flags are set: 1 is any, all of them is ``len(columns)``."""
    total = reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
    return (total >= at_least).cast("int")


def flag_overlap(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n_rows"))


def anomalies(scored: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    return scored.filter(F.col(flag) == 1)
