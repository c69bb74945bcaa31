"""Resumable batch embedding with a pluggable function."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .align import pending

Embedder = Callable[[Sequence[str]], np.ndarray]


def hashing_embedder(dim: int) -> Embedder:
    """Deterministic stand-in: signed word hashing. For tests and dry runs."""
    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                code = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[code % dim] += 1 if code >> 63 else -1
        return out

    return embed


def embed(texts: DataFrame, fn: Embedder, dim: int, model: str, done: DataFrame | None = None,
          on_error: str = "skip", workers: int | None = None, batch_rows: int = 64) -> DataFrame:
    """Vectors of the texts that have none in ``done``: (item_id, v, model, dim, error).

    ``fn`` maps a batch of texts to a matrix. A batch that fails is retried text by text; with
    ``on_error='skip'`` a failing text becomes a row with its error and no vector, with
    ``'raise'`` the run stops. ``workers`` splits the work list into that many tasks; by default its partitions stay. Vectors are normalised when their norm is above zero.
    """
    if on_error not in ("skip", "raise"):
        raise ValueError(on_error)
    todo = texts.select(F.col("item_id").cast("string").alias("item_id"), "text")
    if done is not None:
        todo = pending(todo, done.select(F.col("item_id").cast("string").alias("item_id")))
    target = pa.schema([("item_id", pa.string()), ("v", pa.list_(pa.float32())), ("error", pa.string())])

    def one(item: str, text: str) -> dict:
        try:
            v = np.asarray(fn([text]), np.float32)[0]
            if v.shape != (dim,):
                raise ValueError(f"expected {dim} values, got {v.shape}")
            return {"item_id": item, "v": _unit(v[None])[0], "error": None}
        except Exception as problem:
            if on_error == "raise":
                raise
            return {"item_id": item, "v": None, "error": f"{type(problem).__name__}: {problem}"}

    def run(incoming):
        for batch in incoming:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                ids, chunk = part.column("item_id").to_pylist(), part.column("text").to_pylist()
                try:
                    m = np.asarray(fn(chunk), np.float32)
                    if m.shape != (len(chunk), dim):
                        raise ValueError(f"expected {(len(chunk), dim)}, got {m.shape}")
                    rows = [{"item_id": i, "v": v, "error": None}
                            for i, v in zip(ids, _unit(m), strict=True)]
                except Exception:
                    rows = [one(i, t) for i, t in zip(ids, chunk, strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    out = (todo.repartition(workers) if workers else todo).mapInArrow(run, "item_id string, v array<float>, error string")
    return out.select("item_id", "v", F.lit(model).alias("model"), F.lit(dim).alias("dim"), "error")


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms > 0, norms, 1)
