"""Arrow batches to NumPy and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """List column as an ``n x width`` matrix, without copying the values."""
    if column.null_count or column.flatten().null_count:
        raise ValueError("null features")
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"expected {width} features per row")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def lists(values: np.ndarray) -> pa.Array:
    """Matrix as a list column."""
    n, width = values.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(values).ravel()))
