"""Vector column functions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

SCORE_DIGITS = 10  # scores are rounded so that ties break by id, not by float noise


def matrix(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """An Arrow list column as an ``(n, dim)`` float64 matrix, without a Python loop."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    n = len(vectors)
    if n == 0:
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if flat.size % n or vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != flat.size // n).any():
        raise ValueError("vectors must be non-null and of one dimension")
    return flat.reshape(n, -1)


def normalized(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; a zero row stays zero."""
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    return rows / np.where(norms == 0, 1.0, norms)[:, None]


@F.arrow_udf(ArrayType(DoubleType()))
def l2_normalize(vec: pa.Array) -> pa.Array:
    """Unit-length vectors; a zero vector stays zero."""
    if len(vec) == 0:
        return pa.array([], pa.list_(pa.float64()))
    rows = normalized(matrix(vec))
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1) * rows.shape[1], rows.ravel())


def has_nan(vec: Column) -> Column:
    return F.exists(vec, lambda x: x.isNull() | F.isnan(x))


@F.arrow_udf(DoubleType())
def cosine(left: pa.Array, right: pa.Array) -> pa.Array:
    """Row-wise cosine of two vector columns, one Arrow batch at a time."""
    if len(left) == 0:
        return pa.array([], pa.float64())
    score = np.einsum("ij,ij->i", normalized(matrix(left)), normalized(matrix(right)))
    return pa.array(np.round(score, SCORE_DIGITS))
