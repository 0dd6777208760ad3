"""Standardized feature vectors."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The numeric columns of an event.
BASE_FEATURES = [
    "event_id", "severity_value", "is_system", "process_depth", "hour_of_day", "day_of_week",
    "granted_access", "message_len",
]


class Scaler(NamedTuple):
    """Mean and population deviation per column; deviation 0 marks a constant column."""

    columns: list[str]
    means: list[float]
    deviations: list[float]


def feature_columns(df: DataFrame) -> list[str]:
    return BASE_FEATURES + [c for c in df.columns if c.startswith("eid_")]


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """All moments in one aggregation; one row reaches the driver."""
    row = df.agg(
        *[F.struct(F.avg(_value(c)), F.stddev_pop(_value(c)), F.min(_value(c)) == F.max(_value(c))).alias(f"_{i}")
          for i, c in enumerate(columns)]
    ).first()
    means = [row[i][0] or 0.0 for i in range(len(columns))]
    deviations = [0.0 if row[i][2] else (row[i][1] or 0.0) for i in range(len(columns))]
    return Scaler(columns, means, deviations)


def standardized(scaler: Scaler) -> list[Column]:
    """Z-scores; a constant column gives 0."""
    return [
        (_value(c) - mean) / deviation if deviation else F.lit(0.0)
        for c, mean, deviation in zip(scaler.columns, scaler.means, scaler.deviations)
    ]


def with_features(df: DataFrame, scaler: Scaler, name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*standardized(scaler)))


def max_abs_z(scaler: Scaler) -> Column:
    """Largest absolute z-score of a row, a simple detector with an exact definition."""
    return F.array_max(F.transform(F.array(*standardized(scaler)), F.abs))
