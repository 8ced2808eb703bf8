"""Vectors of a table as integer matrices: which rows are kept, and Arrow list columns as NumPy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column) -> Column:
    """True for a vector that isn't null and holds neither null nor a non-finite entry."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def width(vectors: DataFrame, col: str) -> int:
    """Length that most vectors have, of several such lengths the greatest; 0 without vectors.

    Lengths are counted before they are exchanged, so a row per length is all that travels.
    """
    lengths = vectors.groupBy(F.size(col).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    return first["size"] if first else 0


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * v)`` of each entry ``v`` as a double, as long; beyond its range the nearest long."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * float(scale)).cast("long"))


def longs(column: pa.Array, wide: int) -> np.ndarray:
    """List column of ``wide`` longs a row as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), wide)


def digits(values: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """Integers as ``sum(digit[l] * 2 ** (bits * l))``: digits of ``bits`` bits, the last one signed, as doubles."""
    mask = values.dtype.type((1 << bits) - 1)
    low = [((values >> values.dtype.type(bits * k)) & mask).astype(np.float64) for k in range(count - 1)]
    return [*low, (values >> values.dtype.type(bits * (count - 1))).astype(np.float64)]


def slices(n: int, rows: int):
    """Ranges of at most ``rows`` of ``n`` rows."""
    for a in range(0, n, rows):
        yield slice(a, min(a + rows, n))
