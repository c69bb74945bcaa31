"""Near-duplicate embeddings by random-hyperplane sign hashing (operator 2).

Vectors are compared only within a label. Each of several tables gives a vector the signs of some random
projections; vectors that agree on all bits of a table meet in one of its buckets. Every pair that meets is
verified by its exact cosine in double precision, and counted only in the first table in which it meets. The
bits grow with the base-2 logarithm of the classes of the largest label, so that a vector meets about
one stranger in a table whatever the label's size, and the tables are as many as bring the probability of
missing a pair at the bound down to MISS (16 bits and 42 tables at 65,536 classes; at 0.95 then 0.02 %).

Equal vectors are one class with a weight before anything is hashed. Buckets are cut into blocks of BLOCK
vectors; a task takes a pair of blocks as a matrix product, so that a bucket with a third of all vectors
becomes many small tasks. Out of a block pair come, per vector, the number of new links and one link to
each of the pieces it joins (a spanning forest of the block pair), not the pairs. Components are computed
over these links on all executors. A bucket of n blocks needs n^2 / 2 block products: the price of exact
counts of links; no pair is left out.

Classes carry an id of their own: a vec_id that repeats with other vectors or labels is a vector for each of
them, and its links with itself count. Vectors that are null, empty, zero or hold null or non-finite components, and rows with null label, link
with nothing: n_links 0, component_id their own vec_id. Vectors of different lengths never link. Rows that
repeat with equal vec_id, vector and label are one vector (one row per input row comes back, a repetition is
no link). Vectors may be of any length; ties do not occur, as links depend on the pair alone. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, keep, runs

COSINE = 0.93
MISS = 0.003
LEAST_BITS, MOST_BITS = 8, 30
BLOCK = 512
SEED = 11

_planes: dict[tuple[int, int, int], np.ndarray] = {}


def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    if (dim, tables, bits) not in _planes:
        _planes[dim, tables, bits] = np.random.default_rng([SEED, dim]).standard_normal((dim, tables * bits))
    return _planes[dim, tables, bits]


def signatures(classes: DataFrame, tables: int, bits: int) -> DataFrame:
    """(cid, label, weight, v, codes) of classes (cid, label, weight, v)."""

    def sign(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = batch.column(3)
            size = np.diff(v.offsets.to_numpy())
            flat, start = v.flatten().to_numpy().astype(np.float64), np.cumsum(size) - size
            codes = np.zeros((len(size), tables), np.int32)
            for dim in np.unique(size):
                mine = np.flatnonzero(size == dim)
                x = flat[start[mine][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(1, keepdims=True)
                side = (x @ planes(int(dim), tables, bits) > 0).reshape(len(mine), tables, bits)
                codes[mine] = side @ (1 << np.arange(bits, dtype=np.int32))
            offsets = pa.array(np.arange(len(size) + 1, dtype=np.int32) * tables)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))],
                ["cid", "label", "weight", "v", "codes"])

    return classes.select("cid", "label", "weight", "v").mapInArrow(
        sign, f"cid long, label {classes.schema['label'].dataType.simpleString()}, weight long, v {classes.schema['v'].dataType.simpleString()}, codes array<int>")


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (x, y) between n vertices form a spanning forest."""
    root, use = list(range(n)), np.zeros(len(x), bool)

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            use[i] = True
    return use


def _block_pair(first: pa.RecordBatch, second: pa.RecordBatch, table: int, same: bool, cosine: float):
    """(links: cid, count) and forest (u, v) of new pairs between two blocks of one bucket."""

    def arrays(block):
        n = block.num_rows
        v = np.asarray(block.column("v").flatten(), np.float64).reshape(n, -1)
        v = v / np.abs(v).max(1, keepdims=True)
        v = v / np.sqrt((v ** 2).sum(1, keepdims=True))
        return (block.column("cid").to_numpy(), block.column("weight").to_numpy(), v,
                np.asarray(block.column("codes").flatten()).reshape(n, -1))

    cid, weight, v, codes = arrays(first)
    cid2, weight2, v2, codes2 = (cid, weight, v, codes) if same else arrays(second)
    near = v @ v2.T >= cosine
    if same:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    new = ~(codes[i, :table] == codes2[j, :table]).any(1)
    i, j = i[new], j[new]
    count = np.bincount(i, weight2[j], len(cid)).astype(np.int64)
    count2 = np.bincount(j, weight[i], len(cid2)).astype(np.int64)
    use = _forest(i, j if same else j + len(cid), len(cid) + (0 if same else len(cid2)))
    ids, counts = np.concatenate([cid, cid2]), np.concatenate([count, count2])
    hit = counts > 0
    return ids[hit], counts[hit], cid[i[use]], cid2[j[use]]


def bucket_links(signed: DataFrame, tables: int, cosine: float, block: int = BLOCK) -> DataFrame:
    """(cid, n, u, v): rows of counts (cid, n) and of forest links (u, v)."""
    dim = F.size("v")
    # a block is a bucket's rows by hash; its number of blocks follows from the bucket's size
    rows = signed.select("cid", F.posexplode("codes").alias("t", "code"), "label", dim.alias("dim"))
    sizes = rows.groupBy("t", "code", "label", "dim").count().where("count > 1").withColumn(
        "blocks", F.ceil(F.col("count") / block).cast("int"))
    at = rows.join(sizes.drop("count"), ["t", "code", "label", "dim"]).withColumn(
        "mine", F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int"))
    # each block meets itself and every other one once: pair (low, high)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    at = at.select("*", other.alias("other")).select(
        "cid", "t", "code", "label", "dim", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine")
    full = at.join(signed.select("cid", "weight", "v", "codes"), "cid")
    key = ["t", "code", "label", "dim", "low", "high"]

    def compare(batches):
        for groups in runs(batches, key):
            made = []
            for rows in groups:
                low, high, t = (rows.column(c)[0].as_py() for c in ("low", "high", "t"))
                mine = rows.column("mine").to_numpy()
                a = rows if low == high else rows.filter(pa.array(mine == low))
                b = rows if low == high else rows.filter(pa.array(mine == high))
                if a.num_rows and b.num_rows and rows.num_rows > 1:
                    made.append(_block_pair(a, b, t, low == high, cosine))
            if made:
                ids, counts, u, v = (np.concatenate(x).astype(np.int64) for x in zip(*made, strict=True))
                here, there = pa.nulls(len(ids), pa.int64()), pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in (
                    (pa.array(ids), there), (pa.array(counts), there), (here, pa.array(u)), (here, pa.array(v)))],
                    ["cid", "n", "u", "v"])

    return full.repartition(*key).sortWithinPartitions(*key).mapInArrow(compare, "cid long, n long, u long, v long")


def tables_for(classes: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, bits) for a label of so many classes: about one chance meeting a vector and table, and a pair at
    ``cosine`` missed with probability ``miss`` at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(classes, 2))))))
    agree = (1 - np.arccos(cosine) / np.pi) ** bits
    return int(np.ceil(np.log(miss) / np.log1p(-agree))), bits


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label",
                    cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    base = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vec).alias("v"))
    good = (F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
            & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0))
    # -0.0 + 0.0 is 0.0: equal components have equal bytes
    clean = keep(base.where(F.coalesce(good, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0).cast("float"))).withColumn(
        "h", F.sha2(F.to_binary(F.to_json(F.struct("v")), F.lit("utf-8")), 256)), "vectors")
    classes = keep(clean.groupBy("label", "h").agg(
        F.min("id").alias("rep"), F.count_distinct("id").alias("weight"), F.any_value("v").alias("v")).withColumn(
        "cid", F.monotonically_increasing_id()), "classes")  # ids are fixed once the table is written
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    tables, bits = tables_for(largest, cosine, miss)
    signed = keep(signatures(classes, tables, bits), "signed")
    found = keep(bucket_links(signed, tables, cosine), "links")
    counts = found.where("cid is not null").groupBy("cid").agg(F.sum("n").alias("n"))
    parts = components(found.where("u is not null").select("u", "v")).withColumnRenamed("id", "cid")
    parts = parts.join(classes.select("cid", "rep"), "cid")
    least = parts.groupBy("component").agg(F.min("rep").alias("least"))
    parts = parts.join(least, "component").select("cid", "least")
    summary = classes.select("label", "h", "cid", "rep", "weight").join(counts, "cid", "left").join(parts, "cid", "left").select(
        "label", "h", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    members = clean.select("id", "label", "h").join(summary, ["label", "h"]).select("id", "n_links", "component_id")
    rest = base.where(~F.coalesce(good, F.lit(False))).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return members.unionByName(rest).select(
        F.col("id").alias(vec_id), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
