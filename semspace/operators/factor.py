"""Truncated SVD of sparse rows whose factor (terms x width) is a distributed table of term blocks.

The rows are cut into tiles, a chunk of rows by a block of terms. One pass of the subspace iteration is
Y = X Q by tiles joined to the blocks of Q, then Z = X'Y by tiles joined to the chunks of Y; sums of a
block combine inside the tasks first. Z is made orthonormal from its Gram matrix, twice, since once loses
half the digits. Only width x width numbers reach the driver, whatever the number of terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import arrow_type, ragged, vector_column
from ..sources.storage import materialize

TERM_BLOCK = 8192
HELD_BLOCKS = 64  # dense blocks that a task adds up before it emits them
_PART = "id long, task int, m binary"


@dataclass
class BlockFactor:
    """``table`` (block, m): the rows of the factor for ``TERM_BLOCK`` terms each as one matrix."""

    table: DataFrame
    terms: int
    width: int


def _tiles(sparse: DataFrame, key: str | None) -> DataFrame:
    """(chunk, block, size, rows, cols, weights[, keys]): a batch of rows by a block of terms. With a key
    each chunk also has a tile of block -1 that names its rows."""
    fields = [("chunk", pa.int64()), ("block", pa.int64()), ("size", pa.int32()), ("rows", pa.binary()), ("cols", pa.binary()), ("weights", pa.binary())]
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("block", T.LongType()), T.StructField("size", T.IntegerType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("rows", "cols", "weights")]])
    if key is not None:
        fields.append(("keys", pa.list_(arrow_type(sparse, key))))
        schema = schema.add("keys", T.ArrayType(sparse.schema[key].dataType))
    target = pa.schema(fields)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in incoming:
            n = batch.num_rows
            if not n:
                continue
            rows, terms = ragged(batch.column("indices"))
            weights = batch.column("values").flatten().to_numpy(zero_copy_only=False)
            order = np.argsort(terms // TERM_BLOCK, kind="stable")
            rows, terms, weights = rows[order].astype(np.int32), terms[order], weights[order]
            blocks, starts = np.unique(terms // TERM_BLOCK, return_index=True)
            stops = np.append(starts, len(terms))[1:]
            parts = [(chunk, int(b), n, rows[a:z].tobytes(), (terms[a:z] % TERM_BLOCK).astype(np.int32).tobytes(), weights[a:z].tobytes())
                     for b, a, z in zip(blocks, starts, stops, strict=True)]
            if key is not None:
                parts = [(*p, None) for p in parts] + [(chunk, -1, n, None, None, None, batch.column(key).to_pylist())]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*parts, strict=True), target, strict=True)], schema=target)
            chunk += 1

    columns = ["indices", "values"] + ([key] if key is not None else [])
    return materialize(sparse.select(*columns).mapInArrow(run, schema), "tiles")


def _products(width: int, transposed: bool):
    """Tile times block (by chunk), or its transpose times chunk (by block), added up inside the task."""
    out, other = ("block", "chunk") if transposed else ("chunk", "block")

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: dict[int, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([task] * len(held), pa.int32()),
                                               pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["id", "task", "m"])

        for batch in incoming:
            for at in range(batch.num_rows):
                ident = batch.column(out)[at].as_py()
                rows, cols = (np.frombuffer(batch.column(c)[at].as_py(), np.int32) for c in ("rows", "cols"))
                weights = np.frombuffer(batch.column("weights")[at].as_py())
                dense = np.frombuffer(batch.column("m")[at].as_py()).reshape(-1, width)
                source, target = (rows, cols) if transposed else (cols, rows)
                if ident not in held:
                    if len(held) == HELD_BLOCKS:
                        yield flush()
                        held = {}
                    size = TERM_BLOCK if transposed else batch.column("size")[at].as_py()
                    held[ident] = np.zeros((size, width))
                order = np.argsort(target, kind="stable")
                target, source, weights = target[order], source[order], weights[order]
                first = np.flatnonzero(np.diff(target, prepend=-1))
                if len(first):
                    held[ident][target[first]] += np.add.reduceat(dense[source] * weights[:, None], first, axis=0)
        if held:
            yield flush()

    return run, other


def _added(key: tuple, group: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(m) for m in group["m"].to_pylist())
    return pa.table({"id": pa.array([key[0].as_py()], pa.int64()), "task": pa.array([0], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})


def _sums(parts: DataFrame) -> DataFrame:
    """(id, m) added over the tasks in two rounds."""
    spread = F.floor(F.sqrt("task")).cast("int")
    parts = parts.withColumn("task", spread).groupBy("id", "task").applyInArrow(_added, _PART)
    return parts.groupBy("id").applyInArrow(_added, _PART).select("id", "m")


def _times(tiles: DataFrame, dense: DataFrame, width: int, transposed: bool) -> DataFrame:
    run, other = _products(width, transposed)
    met = tiles.where("block >= 0").join(dense.withColumnRenamed("id", other), other)
    return _sums(met.mapInArrow(run, _PART))


def _gram(left: DataFrame, width: int, shape: np.ndarray, right: DataFrame | None = None) -> np.ndarray:
    """shape' L' R shape over the blocks of ``left`` and ``right`` (itself if None); width x width."""
    both = left if right is None else left.join(right.withColumnRenamed("m", "r"), "id")
    own = right is None

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in incoming:
            for at in range(batch.num_rows):
                x = np.frombuffer(batch.column("m")[at].as_py()).reshape(-1, width) @ shape
                y = x if own else np.frombuffer(batch.column("r")[at].as_py()).reshape(-1, width)
                total += x.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([TaskContext.get().partitionId()], pa.int32()),
                                          pa.array([total.tobytes()], pa.binary())], names=["id", "task", "m"])

    return np.frombuffer(_sums(both.mapInArrow(run, _PART)).first()["m"]).reshape(width, width)


def _whitener(gram: np.ndarray) -> np.ndarray:
    """W with W' gram W the identity; directions without length become zero columns."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    able = values > values.max(initial=0) * 1e-13
    return vectors * np.where(able, 1 / np.sqrt(np.where(able, values, 1)), 0)


def _shaped(blocks: DataFrame, width: int, shape: np.ndarray) -> DataFrame:
    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            made = [(np.frombuffer(m).reshape(-1, width) @ shape).tobytes() for m in batch.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], names=["id", "m"])

    return blocks.mapInArrow(run, "id long, m binary")


def _orthonormal(blocks: DataFrame, width: int) -> DataFrame:
    first = _whitener(_gram(blocks, width, np.eye(width)))
    return _shaped(blocks, width, first @ _whitener(_gram(blocks, width, first)))


def fit_blocks(sparse: DataFrame, terms: int, dim: int, width: int, passes: int, seed: int) -> tuple[BlockFactor, np.ndarray]:
    """(factor, singular values) of the ``dim`` largest singular directions of the rows."""
    spark = sparse.sparkSession
    tiles = _tiles(sparse, None)

    def start(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            made = []
            for block in batch.column("id").to_pylist():
                x = np.random.default_rng([seed, block]).standard_normal((TERM_BLOCK, width))
                x[max(0, terms - block * TERM_BLOCK):] = 0
                made.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], names=["id", "m"])

    q = materialize(spark.range(-(-terms // TERM_BLOCK)).mapInArrow(start, "id long, m binary"), "factor")
    for at in range(passes):
        q = materialize(_orthonormal(q, width), "factor")
        z = materialize(_times(tiles, _times(tiles, q, width, False), width, True), "factor")
        if at < passes - 1:
            q = z
    values, vectors = np.linalg.eigh((lambda b: (b + b.T) / 2)(_gram(q, width, np.eye(width), z)))
    top = np.argsort(-values)[:dim]
    axes = materialize(_shaped(q, width, vectors[:, top]), "axes")

    def extremes(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for m in batch.column("m").to_pylist():
                x = np.frombuffer(m).reshape(-1, dim)
                x = x[np.abs(x).argmax(0), np.arange(dim)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(x)], names=["axis", "x"])

    largest = axes.mapInArrow(extremes, "axis long, x double").groupBy("axis").agg(F.max_by("x", F.struct(F.abs("x"), "x")).alias("x"))
    signs = np.ones(dim)
    for row in largest.collect():  # one row per axis
        signs[row["axis"]] = -1 if row["x"] < 0 else 1
    axes = materialize(_shaped(axes, dim, np.diag(signs)), "axes")
    return BlockFactor(axes, terms, dim), np.sqrt(np.maximum(values[top], 0))


def score_blocks(sparse: DataFrame, factor: BlockFactor, key: str) -> DataFrame:
    """(key, v): the rows on the axes of the factor."""
    width = factor.width
    tiles = _tiles(sparse, key)
    scores = _times(tiles.drop("keys"), factor.table, width, False)
    named = tiles.where("block = -1").select("chunk", "keys", "size").join(scores.withColumnRenamed("id", "chunk"), "chunk", "left")
    key_type = arrow_type(sparse, key)

    def run(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in incoming:
            for at in range(batch.num_rows):
                m = batch.column("m")[at].as_py()
                keys = batch.column("keys")[at].values
                x = np.zeros((len(keys), width)) if m is None else np.frombuffer(m).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([keys.cast(key_type), vector_column(x)], names=[key, "v"])

    schema = T.StructType([sparse.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))])
    return named.mapInArrow(run, schema)
