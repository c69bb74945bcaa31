"""Bringing a small dimension (anchors, seeds, centroids) to the tasks, behind a size check."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import matrix

MAX_DIMENSION_BYTES = 64 << 20
MAX_BROADCAST_ROWS = 100_000


def vector_bytes(df: DataFrame, vec: str = "v") -> tuple[int, int]:
    """(rows, bytes of the vectors as doubles)."""
    size = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(vec)), F.lit(0)).alias("cells")).first()
    return size["n"], size["cells"] * 8


def load_dimension(df: DataFrame, index: str, vec: str = "v",
                   max_bytes: int = MAX_DIMENSION_BYTES) -> tuple[np.ndarray, np.ndarray] | None:
    """(ids, matrix) in index order, or None when the vectors exceed ``max_bytes``."""
    if vector_bytes(df, vec)[1] > max_bytes:
        return None
    table = df.select(F.col(index).cast("long").alias("idx"), F.col(vec).alias("v")).toArrow()
    ids = table["idx"].to_numpy()
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(table["v"])[order] if len(ids) else np.empty((0, 0))


def small_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a legend for broadcast if it has at most ``max_rows`` rows; otherwise leave the choice
    of join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
