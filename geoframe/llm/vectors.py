"""Arrow columns of vectors as numpy matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    """A list column without nulls, all of one length, as rows of a matrix."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1).astype(dtype, copy=False) if len(column) else np.zeros((0, 0), dtype)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.array(values.ravel(), kind))
