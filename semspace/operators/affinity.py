"""Item x anchor affinity, standardised, ranked and rolled up to groups.

One row per item throughout: the affinities of an item sit in one array, position = anchor_idx
(dense from 0). Ranking and roll-up are then row-local; only the per-anchor statistics shuffle,
and those are combined before the shuffle.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import arrow_type, batches, matrix, unit_rows, vector_column
from ..sources.storage import materialize
from .skew import legend_lookup
from .small import MAX_DIMENSION_BYTES, load_dimension

STD_EPSILON = 1e-6
RANGE_EPSILON = 1e-6
RANK_DIGITS = 9  # scores are ranked at 9 decimals, then by index
TILE_ROWS = 4096


def check_same_space(vectors: DataFrame, anchors: DataFrame) -> None:
    """Items and anchors must come from the same model and have the same dimension."""
    def spaces(df: DataFrame) -> set:
        return {tuple(r) for r in df.select("model", "dim").distinct().take(3)}

    if spaces(vectors) != spaces(anchors) or len(spaces(vectors)) > 1:
        raise ValueError("items and anchors were embedded by different models or dimensions")


def _cosines(items: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return unit_rows(items) @ unit_rows(anchors).T


def _squared_distances(items: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    return ((items * items).sum(1)[:, None] + (anchors * anchors).sum(1)[None, :]
            - 2 * items @ anchors.T)


KERNELS = {"cosine": _cosines, "squared_distance": _squared_distances}


def affinity(items: DataFrame, anchors: DataFrame, item_id: str = "item_id", kernel: str = "cosine",
             max_broadcast_bytes: int = MAX_DIMENSION_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Cosine (or squared distance) of every item with every anchor: (item_id, a array<double>).

    ``items``: (item_id, v); ``anchors``: (anchor_idx dense from 0, v).
    """
    score = KERNELS[kernel]
    loaded = load_dimension(anchors, "anchor_idx", max_bytes=max_broadcast_bytes)
    if loaded is None:
        return _affinity_tiled(items, anchors, item_id, score, tile_rows)
    ids, vectors = loaded
    if not len(ids) or not np.array_equal(ids, np.arange(len(ids))):
        raise ValueError("anchor_idx must be dense from 0")
    held = items.sparkSession.sparkContext.broadcast(vectors)
    key_type = arrow_type(items, item_id)
    schema = T.StructType([items.schema[item_id], T.StructField("a", T.ArrayType(T.DoubleType()))])

    def run(incoming):
        anchor_matrix = held.value
        for batch in incoming:
            if batch.num_rows:
                a = score(matrix(batch.column("v")), anchor_matrix)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(item_id).cast(key_type), vector_column(a)], names=[item_id, "a"])

    return items.select(item_id, "v").mapInArrow(run, schema)


def _affinity_tiled(items: DataFrame, anchors: DataFrame, item_id: str, score, tile_rows: int) -> DataFrame:
    """The same for anchors too many to broadcast: tiles of anchors meet bounded chunks of items
    in a co-group, and the pieces of each item's array are put together again."""
    at = anchors.agg(F.count("*").alias("n"), F.count_distinct("anchor_idx").alias("ids"),
                     F.min("anchor_idx").alias("lo"), F.max("anchor_idx").alias("hi")).first()
    if not at["n"] or (at["ids"], at["lo"], at["hi"]) != (at["n"], 0, at["n"] - 1):
        raise ValueError("anchor_idx must be dense from 0")
    tiles = math.ceil(at["n"] / tile_rows)
    # the row number keeps rows with one item_id apart when their pieces are put together
    items = materialize(items.select(item_id, "v").withColumn("row", F.monotonically_increasing_id()), "items")
    chunks = max(1, math.ceil(items.count() / tile_rows))
    left = (items
            .withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
            .withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))))
    right = (anchors.select("anchor_idx", "v")
             .withColumn("tile", F.floor(F.col("anchor_idx") / tile_rows).cast("int"))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))))
    key_type = arrow_type(items, item_id)
    target = pa.schema([(item_id, key_type), ("row", pa.int64()), ("tile", pa.int32()),
                        ("a", pa.list_(pa.float64()))])

    def product(key, some_items: pa.Table, some_anchors: pa.Table) -> pa.Table:
        if not some_items.num_rows or not some_anchors.num_rows:
            return target.empty_table()
        order = np.argsort(some_anchors["anchor_idx"].to_numpy(), kind="stable")
        held = matrix(some_anchors["v"])[order]
        parts = []
        for batch in batches(some_items.combine_chunks().to_batches(), 1024):
            a = score(matrix(batch.column("v")), held)
            tile = pa.array(np.full(batch.num_rows, key[0].as_py(), np.int32))
            parts.append(pa.Table.from_arrays(
                [batch.column(item_id).cast(key_type), batch.column("row"), tile, vector_column(a)], schema=target))
        return pa.concat_tables(parts)

    schema = T.StructType([items.schema[item_id], T.StructField("row", T.LongType()),
                           T.StructField("tile", T.IntegerType()),
                           T.StructField("a", T.ArrayType(T.DoubleType()))])
    pieces = (left.groupBy("tile", "chunk").cogroup(right.groupBy("tile", "chunk"))
              .applyInArrow(product, schema))
    whole = F.sort_array(F.collect_list(F.struct("tile", "a")))
    joined = pieces.groupBy(item_id, "row").agg(F.flatten(F.transform(whole, lambda p: p["a"])).alias("a"))
    return joined.drop("row")


def long_form(df: DataFrame, column: str, index: str, value: str, item_id: str = "item_id") -> DataFrame:
    return df.select(item_id, F.posexplode(column).alias(index, value))


def anchor_stats(aff: DataFrame) -> DataFrame:
    """Per anchor: mean, population std, min and max of the affinity."""
    return (aff.select(F.posexplode("a").alias("anchor_idx", "x")).groupBy("anchor_idx")
            .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
                 F.min("x").alias("lo"), F.max("x").alias("hi")))


def with_table(df: DataFrame, small: DataFrame, index: str, *columns: str) -> DataFrame:
    """Add the rows of a small table, in index order, as one array column ``_table``.

    A scalar subquery, not a join; a column of its own because subqueries may not appear inside
    lambdas.
    """
    rows = F.sort_array(F.collect_list(F.struct(index, *columns)))
    return df.withColumn("_table", small.agg(rows.alias("rows")).scalar())


def anchor_zscore(aff: DataFrame, stats: DataFrame | None = None, item_id: str = "item_id") -> DataFrame:
    """(a - mean) / (std + 1e-6) per anchor: (item_id, z array<double>)."""
    stats = anchor_stats(aff) if stats is None else stats
    aff = with_table(aff, stats, "anchor_idx", "mean", "std")
    z = F.zip_with("a", "_table", lambda a, s: (a - s["mean"]) / (s["std"] + F.lit(STD_EPSILON)))
    return aff.select(item_id, z.alias("z"))


def _by_rank(scores: Column) -> Column:
    """Positions of an array as structs that sort from best to worst."""
    return F.transform(scores, lambda x, i: F.struct((-F.round(x, RANK_DIGITS)).alias("key"),
                                                     i.alias("idx"), x.alias("score")))


def best_index(scores: Column) -> Column:
    """Position of the largest value, the lowest position on ties."""
    return F.array_min(_by_rank(scores))["idx"]


def top_indices(scores: Column, n: int) -> Column:
    """The ``n`` best positions with their scores: array<struct<idx, score>>."""
    return F.transform(F.slice(F.sort_array(_by_rank(scores)), 1, n),
                       lambda s: F.struct(s["idx"].alias("idx"), s["score"].alias("score")))


def top_anchors(z: DataFrame, n: int = 3, item_id: str = "item_id") -> DataFrame:
    """Long form: (item_id, rank from 1, anchor_idx, z)."""
    ranked = z.select(item_id, F.posexplode(top_indices(F.col("z"), n)).alias("at", "best"))
    return ranked.select(item_id, (F.col("at") + 1).alias("rank"),
                         F.col("best.idx").alias("anchor_idx"), F.col("best.score").alias("z"))


def group_membership(anchors: DataFrame, groups: DataFrame) -> DataFrame:
    """Group index of every anchor, -1 where the key names no group."""
    named = legend_lookup(anchors, groups.select("group_key", "group_idx"), "group_key")
    return named.withColumn("group_idx", F.coalesce(F.col("group_idx"), F.lit(-1)).cast("int"))


def group_affinity(z: DataFrame, members: DataFrame, groups: DataFrame,
                   item_id: str = "item_id") -> DataFrame:
    """Mean z over the anchors of each group, 0 for groups without anchors:
    (item_id, sa array<double>), position = group_idx (dense from 0)."""
    held = members.where(F.col("group_idx") >= 0).groupBy("group_idx").agg(
        F.sort_array(F.collect_list(F.col("anchor_idx").cast("int"))).alias("anchors"))
    lists = (groups.select(F.col("group_idx").cast("int").alias("group_idx"))
             .join(held, "group_idx", "left")
             .withColumn("anchors", F.coalesce("anchors", F.array().cast("array<int>"))))

    def mean(g: Column) -> Column:
        anchors = g["anchors"]
        total = F.aggregate(anchors, F.lit(0.0), lambda t, j: t + F.element_at(F.col("z"), j + 1))
        return F.when(F.size(anchors) > 0, total / F.size(anchors)).otherwise(F.lit(0.0))

    z = with_table(z, lists, "group_idx", "anchors")
    return z.select(item_id, F.transform("_table", mean).alias("sa"))


def group_ranges(sa: DataFrame) -> DataFrame:
    return (sa.select(F.posexplode("sa").alias("group_idx", "s")).groupBy("group_idx")
            .agg(F.min("s").alias("lo"), F.max("s").alias("hi")))


def group_minmax(sa: DataFrame, item_id: str = "item_id") -> DataFrame:
    """(s - min) / (range + 1e-6) per group: (item_id, sa01 array<double>)."""
    scaled = F.zip_with(
        "sa", "_table", lambda s, r: (s - r["lo"]) / (r["hi"] - r["lo"] + F.lit(RANGE_EPSILON)))
    sa = with_table(sa, group_ranges(sa), "group_idx", "lo", "hi")
    return sa.select(item_id, scaled.alias("sa01"))
