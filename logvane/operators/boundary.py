"""One-class boundary with an RBF kernel, as a linear machine on random Fourier features.

The kernel is approximated by cosine features [Rahimi, Recht 2007]; the linear
one-class objective is solved by subgradient steps on shards whose weights are
averaged after every round [Zinkevich et al. 2010].
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions.arrays import to_matrix
from logvane.operators.quantiles import exact_quantile
from logvane.session import collect_bounded, materialize, share


class Boundary(NamedTuple):
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    rho: float
    gamma: float


def fourier(points: np.ndarray, directions: np.ndarray, phases: np.ndarray) -> np.ndarray:
    z = points @ directions
    z += phases
    np.cos(z, out=z)
    z *= np.sqrt(2.0 / len(phases))
    return z


def descend(z: np.ndarray, weights: np.ndarray, rho: float, nu: float, first_step: int, steps: int):
    """Subgradient steps on 0.5|w|^2 - rho + mean(max(0, rho - w.z)) / nu."""
    for t in range(first_step, first_step + steps):
        rate = 1.0 / (t + 1)
        inside = z @ weights < rho
        n = np.count_nonzero(inside)
        # few rows are inside after the first steps, and only they pull
        pull = (z[inside].sum(axis=0) if n < len(z) // 4 else inside.astype(float) @ z) / (nu * len(z))
        weights = (1 - rate) * weights + rate * pull
        rho = rho + rate * (1.0 - n / len(z) / nu)
    return weights, rho


def _moments(df: DataFrame, vector: str) -> tuple[int, float]:
    """Width of the vectors and the variance of all their coordinates, in one pass."""
    total = lambda f: F.sum(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), f))
    width, n, first, second = df.agg(
        F.max(F.size(vector)), F.sum(F.size(vector)), total(lambda acc, x: acc + x), total(lambda acc, x: acc + x * x)
    ).first()
    if not n:
        raise ValueError("no rows to fit a boundary on")
    return width, max(0.0, second / n - (first / n) ** 2)


def fit_boundary(
    df: DataFrame, vector: str = "features", nu: float = 0.05, components: int = 256, rounds: int = 2, steps: int = 40,
    block: int = 4_096, seed: int = 42, threshold: bool = True,
) -> Boundary:
    """Fit on all rows; the threshold is the ``nu`` quantile of their scores.

    Every round is one pass: each task descends from the common start over its
    blocks of rows, and Spark sums the weights times the rows behind them. With
    ``threshold`` off the caller sets ``rho`` from scores it stores anyway.
    """
    size, spread = _moments(df, vector)
    gamma = 1.0 / (size * spread) if spread else 1.0
    rng = np.random.default_rng(seed)
    directions = rng.normal(0.0, np.sqrt(2.0 * gamma), (size, components))
    phases = rng.uniform(0.0, 2.0 * np.pi, components)
    fitted = Boundary(directions, phases, np.zeros(components), 0.0, gamma)

    for round_number in range(rounds):
        shared = share(fitted)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, first_step=round_number * steps) -> Iterator[pa.RecordBatch]:
            start = shared.value
            weights, rho, step, rows, waiting = start.weights, start.rho, first_step, 0, []

            def descend_over(points: np.ndarray):
                return descend(fourier(points, start.directions, start.phases), weights, rho, nu, step, steps)

            for batch in batches:
                if len(batch):
                    waiting.append(to_matrix(batch.column(0)))
                if sum(map(len, waiting)) >= block:
                    points, waiting = np.concatenate(waiting), []
                    weights, rho = descend_over(points)
                    step, rows = step + steps, rows + len(points)
            if waiting:
                points = np.concatenate(waiting)
                weights, rho = descend_over(points)
                rows += len(points)
            if rows:
                values = np.concatenate([[1.0, rho], weights]) * rows
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["place", "value"])

        sums = df.select(vector).mapInArrow(learn, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
        found = np.zeros(components + 2)
        for row in collect_bounded(sums, components + 2, "weights"):
            found[row["place"]] = row["value"]
        fitted = fitted._replace(weights=found[2:] / found[0], rho=float(found[1] / found[0]))

    if not threshold:
        return fitted
    scores = materialize(df.select(boundary_score(fitted, vector).alias("score")), "boundary-scores")
    return fitted._replace(rho=exact_quantile(scores, "score", nu))


def boundary_score(model: Boundary, vector: str = "features") -> Column:
    """Lower is more anomalous; below ``model.rho`` is outside."""
    shared = share(model)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        points = to_matrix(column)
        if not len(points):
            return pa.array([], pa.float64())
        m = shared.value
        return pa.array(fourier(points, m.directions, m.phases) @ m.weights)

    return score(F.col(vector))
