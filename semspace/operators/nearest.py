"""Exact nearest-item search: for every query row the ``k`` best items.

Two exact ways. While the item vectors fit ``max_broadcast_bytes`` they are broadcast and each task
multiplies its query batches with them, emitting only the best ``k``.

Beyond that items and queries both stay in bounded blocks around the same pivots (``blocks.py``), packed
into tiles. Consecutive blocks form groups as large as a task's memory and the number of tasks allow; a pair of groups
is one task: each vector moves once per pair of groups, whatever the size of a block, and only a query's best ``k`` of
the pair come out. First every query block meets the item blocks
nearest to it, which gives each query a k-th score; then it meets only the blocks that can still beat the
worst of these scores, by the bound between two rings. Which pairs those are is decided from the table of
blocks alone, before any vector moves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import arrow_type, batches, matrix, ragged, unit_rows
from ..sources.storage import materialize
from .blocks import SCAN_ROWS, AngleBlocks, AngleKernel, PlaneKernel, best_in_single, best_k, mask_excluded
from .grid import grid_nearest

MAX_BROADCAST_BYTES = 256 << 20
# A block of items and a block of queries meet in one task. Both move once per meeting, while the
# product grows with their sizes, so they are as large as a task's memory comfortably allows.
BLOCK_BYTES = 64 << 20
QUERY_BYTES = 64 << 20
TILE_BYTES = 4 << 20
PIVOT_BYTES = 32 << 20
MAX_PIVOTS = 4096
PAIRS_TOGETHER = 64  # pairs of one block that one task of the join makes at most
PAIRS_PER_TASK = 6  # pairs of blocks for every task at least, so that their number evens out
TASK_CELLS = 4_000_000  # scores held at once in one task
SHARE_BYTES = 64 << 20  # of the items that are broadcast at once where they are too many to be so together
FILL_ROWS = 8192  # vectors that are normalised together


class NearestIndex:
    """Items ``(idx long, v array)`` prepared for repeated searches.

    ``copies_kept``: of items with equal vectors only the lowest ids can ever be returned, so the
    distributed form keeps that many of each (0 keeps them all). A search whose k plus exclusions is
    larger prepares the items again with as many as it needs.
    """

    def __init__(self, items: DataFrame, metric: str = "cosine", copies_kept: int = 0,
                 max_broadcast_bytes: int = MAX_BROADCAST_BYTES, block_rows: int | None = None,
                 query_rows: int | None = None, pivots: int | None = None):
        self.spark = items.sparkSession
        self.copies_kept = copies_kept
        items = items.select(F.col("idx").cast("long").alias("idx"), "v")
        size = items.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
        self.n, self.dim = size["n"], size["dim"] or 0
        self.distributed = self.n * self.dim * 8 > max_broadcast_bytes
        if self.distributed:
            if metric != "cosine":
                raise ValueError("only cosine searches are distributed in blocks")
            # blocks as large as memory allows, but enough pairs of them for every task
            self.row_bytes = 8 * max(1, self.dim)
            share = max(256, -(-self.n // int(np.ceil(np.sqrt(PAIRS_PER_TASK * self.parallelism)))))
            self.block_rows = block_rows or max(1, min(share, BLOCK_BYTES // self.row_bytes))
            self.query_rows = query_rows or max(1, min(share, QUERY_BYTES // self.row_bytes))
            self.group_rows = max(self.block_rows, min(share, BLOCK_BYTES // self.row_bytes))
            self.query_group_rows = max(self.query_rows, min(share, QUERY_BYTES // self.row_bytes))
            most = max(1, min(MAX_PIVOTS, PIVOT_BYTES // self.row_bytes))
            self.pivot_count = pivots or min(most, 1 + self.n // self.block_rows)
            self.source, self.tiles, self.kernel = items, None, AngleKernel()
        else:
            self.kernel = AngleKernel() if metric == "cosine" else PlaneKernel()
            self._build_broadcast(items)

    # -- small side: broadcast ------------------------------------------------------------

    def _build_broadcast(self, items: DataFrame) -> None:
        self.data = self._held(items)

    def _held(self, items: DataFrame):
        """Broadcast (ids, vectors) of ``items``, ids ascending, filled a batch at a time."""
        table = items.toArrow()
        ids = table["idx"].to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        vectors, lo = np.empty((len(ids), max(self.dim, 1))), 0
        waiting = table.to_batches(max_chunksize=FILL_ROWS)[::-1]
        del table
        while waiting:  # a batch is let go once it is normalised
            batch = waiting.pop()
            v = matrix(batch.column(batch.schema.get_field_index("v")))
            if len(v) and v.shape[1] != vectors.shape[1]:
                raise ValueError("vectors of different lengths")
            if len(v):
                vectors[place[lo: lo + len(v)]] = self.kernel.prepare(v)
            lo += batch.num_rows
        return self.spark.sparkContext.broadcast((ids[order], vectors))

    def shares(self):
        """The items as broadcast (ids, vectors), one share of bounded bytes after the other; a share is dropped when
        the next one is asked for."""
        if not self.distributed:
            yield self.data
            return
        n = max(1, -(-self.n * self.row_bytes // SHARE_BYTES))
        for at in range(n):
            held = self._held(self.source.where(F.pmod(F.xxhash64("idx"), F.lit(n)) == at))
            yield held
            held.unpersist()

    def _search_broadcast(self, queries: DataFrame, qid: str, k: int, floor: float) -> DataFrame:
        data, kernel = self.data, self.kernel
        has_exclude = "exclude" in queries.columns
        schema = _result_schema(queries, qid)
        target = pa.schema([pa.field(qid, arrow_type(queries, qid)), *_RESULT_ARROW])

        def best(incoming):
            """The best item of each query, with scores by blocks that stay in a core's cache."""
            ids, vectors = data.value
            rough = vectors.astype(np.float32)
            for batch in batches(incoming, SCAN_ROWS):
                if not batch.num_rows or not len(ids):
                    continue
                banned = ragged(batch.column("exclude")) if has_exclude else (np.empty(0, np.int64),) * 2
                at, value = best_in_single(kernel.prepare(matrix(batch.column("v"))), vectors, rough, ids, *banned)
                rows = np.flatnonzero(value > floor)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(qid).take(pa.array(rows)).cast(target.field(0).type), pa.array(ids[at[rows]]),
                     pa.array(value[rows]), pa.array(np.ones(len(rows), np.int32))], schema=target)

        def run(incoming):
            ids, vectors = data.value
            step = max(1, TASK_CELLS // max(1, len(ids)))
            for batch in batches(incoming, step):
                if not batch.num_rows or not len(ids):
                    continue
                scores = kernel.scores(kernel.prepare(matrix(batch.column("v"))), vectors)
                if has_exclude:
                    mask_excluded(scores, ids, *ragged(batch.column("exclude")))
                rows, found, value, rank = best_k(scores, ids, k, floor, kernel.digits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(qid).take(pa.array(rows)).cast(target.field(0).type),
                     pa.array(found), pa.array(value), pa.array(rank)], schema=target)

        single = k == 1 and kernel.digits is not None
        return queries.repartition(self.parallelism, qid).mapInArrow(best if single else run, schema)

    @property
    def parallelism(self) -> int:
        """Tasks for the compute-bound product: its cost per query row far exceeds moving the row."""
        return max(self.spark.sparkContext.defaultParallelism,
                   int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    # -- large side: bounded blocks -------------------------------------------------------

    def _build_blocks(self) -> None:
        items, pivots = self.source, self.pivot_count
        if self.copies_kept:
            copies = Window.partitionBy(F.xxhash64("v"), "v").orderBy("idx")
            items = (items.withColumn("copy", F.row_number().over(copies))
                     .where(F.col("copy") <= self.copies_kept).drop("copy"))
        items = materialize(items, "items")
        sample = items.orderBy(F.xxhash64("idx"), "idx").limit(pivots).toArrow()
        blank = AngleBlocks(pivots=unit_rows(matrix(sample["v"])))
        self.kernel, self.tiles = self._packed(items, "idx", blank, self.block_rows)
        self.data = self.spark.sparkContext.broadcast(self.kernel)

    def _with_copies(self, need: int) -> NearestIndex:
        """This index, or one that keeps at least ``need`` of the items with equal vectors."""
        if not self.copies_kept or need <= self.copies_kept:
            return self
        return NearestIndex(self.source, copies_kept=1 << (need - 1).bit_length(), max_broadcast_bytes=-1,
                            block_rows=self.block_rows, query_rows=self.query_rows, pivots=self.pivot_count)

    def _packed(self, rows: DataFrame, key: str, blank: AngleBlocks, block_rows: int) -> tuple[AngleBlocks, DataFrame]:
        """The blocks of ``rows`` (key, v[, exclude]) and their tiles: (block, ids, v[, exclude]), the
        vectors of a tile as the bytes of one matrix in their own precision, ids ascending in a block."""
        binner = self.spark.sparkContext.broadcast(blank)
        numeric = isinstance(rows.schema[key].dataType, (T.LongType, T.IntegerType))
        place = F.col(key).cast("long") if numeric else F.xxhash64(key)
        rows = rows.withColumn("place", place)

        def bins(incoming):
            kern = binner.value
            for batch in incoming:
                if batch.num_rows:
                    group, cell = kern.bin_of(kern.prepare(matrix(batch.column("v"))))
                    yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(cell)], names=["group", "bin"])

        counted = rows.select("v").mapInArrow(bins, "group long, bin long").groupBy("group", "bin").count().toArrow()
        counts = np.zeros(blank.shape, np.int64)
        counts[counted["group"].to_numpy(), counted["bin"].to_numpy()] = counted["count"].to_numpy()
        kernel = blank.cut(counts, block_rows)
        held = self.spark.sparkContext.broadcast(kernel)
        carried = [c for c in rows.columns if c != "place"]

        def assign(incoming):
            kern = held.value
            for batch in incoming:
                if batch.num_rows:
                    group, cell = kern.bin_of(kern.prepare(matrix(batch.column("v"))))
                    block = kern.block_of(group, cell, batch.column("place").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(block), *[batch.column(c) for c in carried]], names=["block", *carried])

        single = rows.schema["v"].dataType.elementType == T.FloatType()
        has_exclude = "exclude" in carried
        fields = [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema[key].dataType)),
                  T.StructField("v", T.BinaryType())]
        fields += [T.StructField("exclude", T.ArrayType(T.ArrayType(T.LongType())))] if has_exclude else []
        step = max(1, TILE_BYTES // self.row_bytes)

        def pack(group: pa.Table) -> pa.Table:
            group = group.sort_by(key)
            parts = [group.slice(at, step) for at in range(0, group.num_rows, step)]
            out = {"block": [part["block"][0].as_py() for part in parts], "ids": [part[key].combine_chunks() for part in parts],
                   "v": [matrix(part["v"]).astype(np.float32 if single else np.float64).tobytes() for part in parts]}
            arrays = [pa.array(out["block"], pa.int64()), _lists(out["ids"]), pa.array(out["v"], pa.binary())]
            if has_exclude:
                arrays.append(_lists([part["exclude"].combine_chunks().cast(pa.list_(pa.int64())) for part in parts]))
            return pa.Table.from_arrays(arrays, names=["block", "ids", "v", *["exclude"] * has_exclude])

        schema = T.StructType([fields[0], *[rows.schema[c] for c in carried]])
        placed = rows.mapInArrow(assign, schema)
        return kernel, materialize(placed.groupBy("block").applyInArrow(pack, T.StructType(fields)), "tiles")

    def _pairs(self, own: AngleBlocks, worst: DataFrame | None, need: int, floor: float) -> DataFrame:
        """(asked, block, ag, bg) pairs to visit and the groups of the two: the nearest blocks that hold ``need`` items together, or, given
        the (asked, worst) score of every query block, all others that can beat it."""
        items, mine = self.data, self.spark.sparkContext.broadcast(own)
        rest = worst is not None
        asked_group, block_group = _groups(own.rows, self.query_group_rows), _groups(self.kernel.rows, self.group_rows)

        def run(incoming):
            kern, asking = items.value, mine.value
            for batch in incoming:
                for at, asked in enumerate(batch.column("asked").to_pylist()):
                    bound, guess = asking.block_bound(asked, kern)
                    order = np.lexsort((-guess, -np.round(bound, 6)))
                    before = np.cumsum(kern.rows[order]) - kern.rows[order]
                    visit = np.zeros(len(bound), bool)
                    visit[order[before < need]] = True
                    if rest:
                        visit = ~visit & (bound >= max(floor, batch.column("worst")[at].as_py()))
                    else:
                        visit &= bound >= floor
                    block = np.flatnonzero(visit)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(block), asked)), pa.array(block), pa.array(np.full(len(block), asked_group[asked])),
                         pa.array(block_group[block])], names=["asked", "block", "ag", "bg"])

        blocks = self.spark.range(own.count()).select(F.col("id").alias("asked"))
        if rest:
            blocks = worst.select("asked", "worst")
        return materialize(blocks.mapInArrow(run, "asked long, block long, ag long, bg long"), "pairs")

    def _meet(self, asked: DataFrame, pairs: DataFrame, k: int, floor: float, id_type: T.DataType) -> DataFrame:
        """(asked, qid, idx, score): the best ``k`` of every query in every pair of blocks."""
        kernel = self.data
        has_exclude, has_bound = "exclude" in asked.columns, "bound" in asked.columns
        schema = T.StructType([T.StructField("asked", T.LongType()), T.StructField("qid", id_type), *_RESULT_FIELDS[:2]])
        single = self.source.schema["v"].dataType.elementType == T.FloatType()

        def search(key, queries: pa.Table, held: pa.Table) -> pa.Table:
            kern = kernel.value
            tiles = {}
            for at, block in enumerate(held["block"].to_pylist()):
                tiles.setdefault(block, []).append(at)
            held_ids, held_v = _each(held["ids"]), held["v"]
            asking = []
            for at, ids in enumerate(_each(queries["ids"])):
                q = kern.prepare(_unpacked(queries["v"][at].as_py(), len(ids), queries["single"][at].as_py()))
                bound = np.array(_each(queries["bound"])[at]) if has_bound else np.full(len(q), -np.inf)
                bans = ragged(_each(queries["exclude"])[at]) if has_exclude else (np.empty(0, np.int64),) * 2
                none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
                asking.append([set(queries["blocks"][at].as_py()), q, bound, *bans, none])
            for block, places in tiles.items():
                items = [(np.asarray(held_ids[at]), kern.prepare(_unpacked(held_v[at].as_py(), len(held_ids[at]), single))) for at in places]
                for one in asking:
                    if block in one[0]:
                        one[5] = _best_of(kern, block, items, *one[1:], k, floor)
            parts = []
            for at, ids in enumerate(_each(queries["ids"])):
                rows, found, value = asking[at][5]
                parts.append(pa.table({"asked": pa.array(np.full(len(rows), queries["asked"][at].as_py()), pa.int64()), "qid": ids.take(pa.array(rows)),
                                       "idx": pa.array(found, pa.int64()), "score": pa.array(value, pa.float64())}))
            return pa.concat_tables(parts) if parts else pa.table(
                {"asked": pa.array([], pa.int64()), "qid": pa.array([], queries["ids"].type.value_type),
                 "idx": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

        met = pairs.groupBy("asked", "ag", "bg").agg(F.collect_list("block").alias("blocks"))  # blocks of one group
        left = _beside(asked.withColumnRenamed("block", "asked"), materialize(met, "met"), "asked", "bg")
        right = _beside(self.tiles, materialize(pairs.select("block", "ag", "bg").distinct(), "met"), "block", "ag")
        found = left.groupBy("ag", "bg").cogroup(right.groupBy("ag", "bg")).applyInArrow(search, schema)
        return materialize(found, "found")

    def _search_blocks(self, queries: DataFrame, qid: str, k: int, floor: float) -> DataFrame:
        id_type = queries.schema[qid].dataType
        queries = materialize(queries, "queries")
        if self.tiles is None:
            self._build_blocks()
        banned = queries.agg(F.max(F.size("exclude"))).first()[0] if "exclude" in queries.columns else 0
        need = k + max(0, banned or 0)
        if need > (self.copies_kept or need):
            return self._with_copies(need)._search_blocks(queries, qid, k, floor)
        single = queries.schema["v"].dataType.elementType == T.FloatType()
        own, tiles = self._packed(queries.withColumnRenamed(qid, "qid"), "qid", AngleBlocks(pivots=self.kernel.pivots), self.query_rows)
        tiles = tiles.withColumn("single", F.lit(single))
        first = self._meet(tiles, self._pairs(own, None, need, floor), k, floor, id_type)
        bounded = materialize(_with_bounds(tiles, first, k), "bounded")
        worst = bounded.groupBy(F.col("block").alias("asked")).agg(F.min(F.array_min("bound")).alias("worst"))
        rest = self._meet(bounded, self._pairs(own, worst, need, floor), k, floor, id_type)
        ranked = _ranked(first.unionByName(rest), "qid", k)
        return ranked.select(F.col("qid").alias(qid), "idx", "score", "rank")

    # -------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int, qid: str = "qid", floor: float = -np.inf) -> DataFrame:
        """``queries``: a unique id column, ``v`` and optionally ``exclude array<bigint>``, the item
        ids ruled out for that row. Returns (qid, idx, score, rank), scores strictly above
        ``floor``, equal scores by lower idx."""
        keep = [qid, F.col("v")]
        if "exclude" in queries.columns:
            keep.append(F.col("exclude"))
        queries = queries.select(*keep)
        if self.distributed:
            return self._search_blocks(queries, qid, k, floor)
        return self._search_broadcast(queries, qid, k, floor)


    def best_ranks(self, queries: DataFrame, k: int, qid: str = "qid") -> DataFrame:
        """(idx, rank) of every item among the best ``k`` of any query: its best rank. Where the items
        are broadcast a task reports an item once, however many queries it has seen."""
        if self.distributed:
            found = self.search(queries, k, qid)
        else:
            data, kernel = self.data, self.kernel

            def run(incoming):
                ids, vectors = data.value
                best = np.full(len(ids), k + 1, np.int32)
                for batch in batches(incoming, max(1, TASK_CELLS // max(1, len(ids)))):
                    if batch.num_rows and len(ids):
                        scores = kernel.scores(kernel.prepare(matrix(batch.column("v"))), vectors)
                        _, found, _, rank = best_k(scores, ids, k, digits=kernel.digits)
                        np.minimum.at(best, np.searchsorted(ids, found), rank)
                at = np.flatnonzero(best <= k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best[at])], names=["idx", "rank"])

            found = queries.select("v").repartition(self.parallelism).mapInArrow(run, "idx long, rank int")
        return found.groupBy("idx").agg(F.min("rank").alias("rank"))


_RESULT_FIELDS = [T.StructField("idx", T.LongType()), T.StructField("score", T.DoubleType()),
                  T.StructField("rank", T.IntegerType())]
_RESULT_ARROW = [pa.field("idx", pa.int64()), pa.field("score", pa.float64()),
                 pa.field("rank", pa.int32())]


def _groups(rows: np.ndarray, limit: int) -> np.ndarray:
    """A group for each block: consecutive blocks of about ``limit`` rows together."""
    return (np.cumsum(rows) - rows) // limit


def _best_of(kern: AngleBlocks, block: int, tiles: list, q: np.ndarray, bound: np.ndarray, ban_rows: np.ndarray, banned: np.ndarray,
             so_far: tuple, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score): the best ``k`` of every query among ``so_far`` and the items of a block; ``bound`` rises with them."""
    able = np.flatnonzero(kern.query_bound(q, block) >= np.maximum(bound, floor))
    best = [so_far]
    for item_ids, items in tiles:
        step = max(1, TASK_CELLS // max(1, len(item_ids)))
        for start in range(0, len(able), step):
            some = able[start: start + step]
            scores = kern.scores(q[some], items)
            if len(ban_rows):
                row_of = np.full(len(q), -1)
                row_of[some] = np.arange(len(some))
                mine = row_of[ban_rows] >= 0
                mask_excluded(scores, item_ids, row_of[ban_rows[mine]], banned[mine])
            rows, found, value, _ = best_k(scores, item_ids, k, floor, kern.digits)
            rows = some[rows]
            keep = value >= bound[rows]
            best.append((rows[keep], found[keep], value[keep]))
    if len(best) == 1:
        return so_far
    rows, found, value = (np.concatenate(x) for x in zip(*best, strict=True))
    order = np.lexsort((found, -value, rows))
    rows, found, value = rows[order], found[order], value[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    full = rank == k - 1
    bound[rows[full]] = np.maximum(bound[rows[full]], value[full])
    return rows[rank < k], found[rank < k], value[rank < k]


def _lists(parts: list[pa.Array]) -> pa.ListArray:
    """One list per array."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(parts))


def _each(column: pa.ChunkedArray) -> list[pa.Array]:
    """The lists of a column as arrays."""
    return [value.values for chunk in column.chunks for value in chunk]


def _unpacked(tile: bytes, n: int, single: bool) -> np.ndarray:
    return np.frombuffer(tile, np.float32 if single else np.float64).reshape(n, -1).astype(np.float64)


def _beside(tiles: DataFrame, pairs: DataFrame, key: str, other: str) -> DataFrame:
    """``tiles`` once per pair of their block. A block with many pairs is spread over several tasks."""
    salts = pairs.groupBy(key).agg(F.ceil(F.count("*") / F.lit(PAIRS_TOGETHER)).cast("int").alias("salts"))
    salts = materialize(salts, "salts")
    left = pairs.join(salts, key).withColumn("salt", F.pmod(F.xxhash64(other), F.col("salts")).cast("int")).drop("salts")
    right = tiles.join(salts, key).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return right.join(left, [key, "salt"]).drop("salt")


def _with_bounds(tiles: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The query tiles with ``bound``, each query's k-th score so far, -inf where it has fewer."""
    kth = _ranked(first, "qid", k).where(F.col("rank") == k).select("asked", "qid", F.col("score").alias("bound"))
    kth = kth.groupBy(F.col("asked").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("qid", "bound"))).alias("known"))
    bound = F.transform("ids", lambda i: F.coalesce(F.try_element_at("known", i), F.lit(-np.inf)))
    return tiles.join(kth, "block", "left").withColumn(
        "bound", F.when(F.col("known").isNull(), F.transform("ids", lambda i: F.lit(-np.inf))).otherwise(bound)).drop("known")


def _result_schema(queries: DataFrame, qid: str) -> T.StructType:
    return T.StructType([queries.schema[qid], *_RESULT_FIELDS])


def _ranked(found: DataFrame, qid: str, k: int) -> DataFrame:
    order = Window.partitionBy(qid).orderBy(F.desc("score"), "idx")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_graph(items: DataFrame, k: int = 10, **index) -> DataFrame:
    """Directed k-nearest-neighbour edges (src, dst, rank, sim) under cosine, self excluded by id."""
    items = items.select(F.col("idx").cast("long").alias("idx"), "v")
    nearest = NearestIndex(items, copies_kept=k + 1, **index)
    queries = items.withColumn("exclude", F.array("idx")).withColumnRenamed("idx", "src")
    return nearest.search(queries, k, qid="src").select(
        "src", F.col("idx").alias("dst"), "rank", F.col("score").alias("sim"))


def radius_nearest(queries: DataFrame, items: DataFrame, radius: float, max_broadcast_bytes: int = 1 << 20, **grid) -> DataFrame:
    """The nearest item strictly within ``radius`` of each query point (qid, x, y); items are
    (idx, x, y). Queries with none are left out; equal distances go to the lower idx. Few items are
    broadcast; beyond ``max_broadcast_bytes`` both sides meet in a hashed grid."""
    def points(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    asked, held = points(queries, "qid"), points(items, "idx")
    if held.count() * 24 > max_broadcast_bytes:
        return grid_nearest(asked, held, radius, **grid)

    def vectors(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.array("x", "y").alias("v"))

    found = NearestIndex(vectors(held, "idx"), metric="plane").search(vectors(asked, "qid"), 1, floor=-radius * radius)
    return found.select("qid", "idx", F.sqrt(-F.col("score")).alias("dist"))
