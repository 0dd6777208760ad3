"""Reconstruction error of a small encoder-decoder, for structure that no linear projection shows.

Two tanh layers around a narrow middle are trained on all rows in rounds. Rows
are dealt to learning units by a hash of their key, as many units as keep a
unit below ``ROWS_PER_UNIT`` rows; in a round every unit goes once through its
own rows in the order of their hashes, from common parameters, and Spark
averages what the units have learned, weighed by their rows. Neither units nor
order hang on partitions, so the model does not change with the file layout.

Defined cases: null coordinates are not allowed in vectors. Rows that repeat a
key learn in the same unit. An empty table is refused. Scoring shuffles nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions.arrays import to_matrix
from logvane.session import materialize, share

HIDDEN, MIDDLE = 16, 2
ROWS_PER_UNIT, BATCH = 20_000, 64
ROUNDS, STEP = 12, 0.01


class Layout(NamedTuple):
    """Sizes of the layers, from which flat parameters are read."""

    width: int
    hidden: int
    middle: int

    def shapes(self) -> list[tuple[int, int]]:
        d, h, m = self
        return [(d + 1, h), (h + 1, m), (m + 1, h), (h + 1, d)]

    def parts(self, flat: np.ndarray) -> list[np.ndarray]:
        ends = np.cumsum([a * b for a, b in self.shapes()])
        return [p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), self.shapes())]

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return np.concatenate([(rng.normal(size=s) / np.sqrt(s[0])).ravel() for s in self.shapes()])


class Autoencoder(NamedTuple):
    """A fitted model."""

    layout: Layout
    flat: np.ndarray


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def reconstruct(layout: Layout, flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    a, b, c, d = layout.parts(flat)
    return _with_one(np.tanh(_with_one(_with_one(np.tanh(_with_one(x) @ a)) @ b) @ c)) @ d


def gradient(layout: Layout, flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean squared error of a batch and its gradient."""
    a, b, c, d = layout.parts(flat)
    x1 = _with_one(x)
    h1 = _with_one(np.tanh(x1 @ a))
    m1 = _with_one(h1 @ b)
    g1 = _with_one(np.tanh(m1 @ c))
    wrong = g1 @ d - x
    out = 2.0 * wrong / wrong.size
    back_g = (out @ d.T)[:, :-1] * (1 - g1[:, :-1] ** 2)
    back_m = (back_g @ c.T)[:, :-1]
    back_h = (back_m @ b.T)[:, :-1] * (1 - h1[:, :-1] ** 2)
    return float((wrong**2).mean()), np.concatenate([p.ravel() for p in (x1.T @ back_h, h1.T @ back_m, m1.T @ back_g, g1.T @ out)])


def _descend(layout: Layout, flat: np.ndarray, x: np.ndarray, step: float) -> np.ndarray:
    """Parameters after one pass over the rows in batches (Adam)."""
    flat, first, second = flat.copy(), np.zeros_like(flat), np.zeros_like(flat)
    for t, at in enumerate(range(0, len(x), BATCH), 1):
        _, g = gradient(layout, flat, x[at : at + BATCH])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        flat -= step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return flat


def _learner(layout: Layout, shared: Broadcast, step: float):
    """One unit's pass from the common parameters."""
    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(raw=[v.tobytes() for v in part["v"]]).sort_values(["h", "raw"], kind="stable")
        learned = _descend(layout, shared.value, np.stack(part["v"].to_numpy()).astype(float), step)
        return pd.DataFrame({"flat": [learned], "n": [float(len(part))]})

    return learn


def fit_autoencoder(
    df: DataFrame, key: str, vector: str = "features", middle: int = MIDDLE, hidden: int = HIDDEN, rounds: int = ROUNDS,
    step: float = STEP, rows_per_unit: int = ROWS_PER_UNIT, seed: int = 5,
) -> Autoencoder:
    """Learn from all rows."""
    rows = df.select(F.xxhash64(F.col(key)).alias("h"), F.col(vector).cast("array<double>").alias("v"))
    count, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not count:
        raise ValueError("no rows to learn from")
    units = -(-count // rows_per_unit)
    rows = materialize(rows.withColumn("unit", F.pmod(F.xxhash64("h"), F.lit(units))), "units")
    layout = Layout(width, hidden, middle)
    flat = layout.start(seed)
    for number in range(rounds):
        shared = share(flat)
        learned = rows.groupBy("unit").applyInPandas(_learner(layout, shared, step * (1 - number / rounds)), "flat array<double>, n double")
        flat = learned.select(array_to_vector("flat").alias("flat"), "n").select(Summarizer.mean(F.col("flat"), F.col("n"))).first()[0].toArray()
        shared.unpersist()
    return Autoencoder(layout, flat)


def reconstruction_error(model: Autoencoder, vector: str = "features") -> Column:
    """Mean squared difference between a vector and what the model makes of it; higher is more anomalous."""
    shared = share(model)

    @F.arrow_udf("double")
    def error(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.float64())
        x, m = to_matrix(column), shared.value
        return pa.array(((reconstruct(m.layout, m.flat, x) - x) ** 2).mean(axis=1))

    return error(F.col(vector))
