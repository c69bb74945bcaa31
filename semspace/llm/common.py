"""Shared pieces: byte-level text kernels for Arrow batches, scratch tables, connected components.

The kernels work on the UTF-8 bytes of many rows at once. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D, which are never part of a longer UTF-8 sequence. Hashes are 64-bit sums of random
byte values times powers of an odd number, so that the hash of any range is a difference of prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.storage import materialize, scratch_path, shared_dir

__all__ = ["BITMAP_BITS", "Words", "bitmap", "components", "documents", "drop", "flat", "in_bitmap", "keep", "mix", "prepare", "runs", "scratch_path", "seq_hash",
           "shared_dir", "slices", "table", "to_long"]

SLICE_BYTES = 1 << 18  # bytes of text that a kernel takes at once; one longer row is a slice of its own
BITMAP_BITS = 1 << 25
BATCH_ROWS = 1000  # rows that go to Python at once: texts and sets are long

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable in the workers and, unless the session sets it, bound the rows that a
    batch brings to Python (Spark's own 10,000 whole texts or sets would be tens of MB)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(BATCH_ROWS))
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cut lineage that survives lost executors."""
    return materialize(df, f"llm-{name}")


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``keep`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=False)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def to_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def seq_hash(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the ranges [lo, hi) of ``values``, unmixed."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=sums[1:])
    return (sums[hi] - sums[lo]) * _power(_INVERSE, len(values) + 1)[lo]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes."""
    data, offsets = flat(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


class Words:
    """The words of several rows: byte ranges, row of each, first word of each row, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        gap = _SEPARATOR[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        before[edge], after[edge - 1] = True, True
        self.starts = np.flatnonzero(before & ~gap)
        self.ends = np.flatnonzero(after & ~gap) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.rows = np.repeat(np.arange(len(offsets) - 1), self.counts)
        raw = seq_hash((_LOWER if lower else _BYTE)[data], self.starts, self.ends)
        self.hash = mix(raw + (self.ends - self.starts).astype(np.uint64))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every window of k words; a row of fewer words gives its whole sequence."""
        n = len(self.hash)
        at = np.flatnonzero(self.rows[: n - k + 1] == self.rows[k - 1:]) if n >= k else np.empty(0, np.int64)
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        lo = np.concatenate([at, self.first[short]])
        hi = np.concatenate([at + k, self.first[short + 1]])
        rows = np.concatenate([self.rows[at], short])
        return rows, mix(seq_hash(self.hash, lo, hi) + (hi - lo).astype(np.uint64))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[pa.RecordBatch]]:
    """The complete groups of rows with equal ``keys``, as far as each batch reaches. Rows are sorted by the
    keys; a group is held while it is incomplete, so groups must be of bounded size."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if held:
            batch = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            x = batch.column(key).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        held = [batch.slice(cuts[-1])]
        if len(cuts) > 1:
            yield [batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if held:
        yield held


def bitmap(places: DataFrame) -> Broadcast:
    """Broadcast bitmap of fixed size (4 MB) with the bits ``at`` of ``places`` set: a filter before a
    join. Beyond its capacity it lets more rows through, never fewer."""
    words = places.groupBy(F.expr("at div 64").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits")).toArrow()
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    bits[words["w"].to_numpy()] = words["bits"].to_numpy()
    return places.sparkSession.sparkContext.broadcast(bits)


def in_bitmap(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[at >> 6] >> (at & 63)) & 1) == 1


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id that has an edge (u, v): the smallest id it is connected to.

    Alternates large-star and small-star steps, which halve the depth of chains, until every id hangs on
    its smallest one. Each round is a table in the shared folder; a hub's edges are split by the skew
    handling of the join, and minima are combined before their shuffle.
    """
    edges = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = keep(small.where("u <> v").distinct(), "stars")
        drop(edges)
        edges = new
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if now == state:
            break
        state = now
    # every id points at its root only; roots name themselves
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select("v", "v").distinct()).distinct()
