"""Moving float arrays between Arrow and numpy, a batch at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def to_matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists all have the same length, as rows of a matrix."""
    if len(column) == 0:
        return np.empty((0, 0))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False)


def from_matrix(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype=np.int32) if width else np.zeros(rows + 1, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))
