"""Principal components: reconstruction error and low-dimensional projections."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvane.functions.arrays import from_matrix, to_matrix
from logvane.session import share


class Components(NamedTuple):
    center: np.ndarray
    loadings: np.ndarray
    explained: np.ndarray


def fit_components(
    df: DataFrame, k: int | None = None, vector: str = "features", min_explained: float | None = None,
    center: float | None = None,
) -> Components:
    """The first ``k`` components, all without ``k``; with ``min_explained`` the fewest that explain that share.

    Raises where ``k`` components explain less than asked for, and on an empty table.

    ``center`` states the mean of every coordinate where it is known, as for
    standardized features, and saves a pass. The sign of a component is fixed by
    making its largest loading positive.
    """
    vectors = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    first = df.select(F.size(vector)).first()
    if first is None:
        raise ValueError("no rows to fit components on")
    width = first[0]
    fitted = PCA(k=min(k or width, width), inputCol="v", outputCol="p").fit(vectors)
    loadings, explained = fitted.pc.toArray(), fitted.explainedVariance.toArray()
    if center is None:
        middle = vectors.select(Summarizer.mean(F.col("v"))).first()[0].toArray()
    else:
        middle = np.full(width, center)
    if min_explained is not None:
        # constant coordinates alone leave nothing to explain
        explained = np.nan_to_num(explained)
        enough = int(np.searchsorted(np.cumsum(explained), min_explained - 1e-9)) + 1 if explained.any() else 1
        if enough > len(explained):
            raise ValueError(f"{len(explained)} components explain {explained.sum():.3f}, not {min_explained}")
        loadings, explained = loadings[:, :enough], explained[:enough]
    largest = loadings[np.abs(loadings).argmax(axis=0), np.arange(loadings.shape[1])]
    return Components(middle, loadings * np.where(largest < 0, -1.0, 1.0), explained)


def reconstruction_error(model: Components, vector: str = "features") -> Column:
    """Mean squared residual after projecting on the components; higher is more anomalous."""
    shared = share(model)

    @F.arrow_udf("double")
    def error(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.float64())
        m = shared.value
        centered = to_matrix(column) - m.center
        residual = centered - (centered @ m.loadings) @ m.loadings.T
        return pa.array((residual**2).mean(axis=1))

    return error(F.col(vector))


def project(model: Components, vector: str = "features") -> Column:
    """Coordinates on the components."""
    shared = share(model)

    @F.arrow_udf("array<double>")
    def coordinates(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float64()))
        m = shared.value
        return from_matrix((to_matrix(column) - m.center) @ m.loadings)

    return coordinates(F.col(vector))
