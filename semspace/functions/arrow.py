"""Arrow batches <-> numpy matrices, used inside tasks only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(df.schema[column].dataType)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal-length vectors as an (n, dim) float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.empty((0, 0))
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != lengths[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1)


def unit_rows(m: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + eps)


def vector_column(m: np.ndarray) -> pa.ListArray:
    n, dim = m.shape
    offsets = np.arange(0, (n + 1) * dim, dim, dtype=np.int32) if dim else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def ragged(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, value) pairs of a list column of integers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), lengths), values


def batches(table_iter, rows: int):
    """Re-slice record batches so that none is longer than ``rows``."""
    for batch in table_iter:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
