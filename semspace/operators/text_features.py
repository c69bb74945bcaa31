"""Tokens, n-grams, TF-IDF and latent semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import arrow_type, ragged, vector_column
from ..functions.columns import let
from ..functions.stopwords import ENGLISH
from ..functions.vectors import l2_normalize
from ..sources.storage import materialize
from .clean import dense_index
from .factor import BlockFactor, fit_blocks, score_blocks
from .small import MAX_BROADCAST_ROWS

LOCAL_TERMS = 200_000  # terms that are sent to every task; a larger vocabulary is joined
FEW_TASKS = 64  # whose partial sums are added in one round
LOCAL_FACTOR_BYTES = 16 << 20  # of terms x width that the driver and every task hold

BATCH_ROWS = 500  # documents that go to Python at once
SLICE_TERMS = 1 << 18  # terms that are counted together; one longer document is a slice of its own

TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"


def words(text: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Lower-case words of two characters or more, stop words removed."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(1))
    return F.filter(found, lambda w: ~w.isin(list(stop_words))) if stop_words else found


def word_ngrams(text: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Words followed by their 2-grams (formed after the stop words are gone)."""
    def with_pairs(w: Column) -> Column:
        n = F.size(w) - 1
        pairs = F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n),
                           lambda a, b: F.concat(a, F.lit(" "), b))
        return F.when(n > 0, F.concat(w, pairs)).otherwise(w)

    return let(words(text, stop_words), with_pairs)


def _runs(terms: Column) -> Column:
    """(term, tf) of the distinct terms of an array."""
    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)),
                          lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, F.greatest(i - 2, F.lit(0)))))
        ends = lambda p: F.concat(F.slice(p, F.lit(2), F.size(p)), F.array(F.size(s) + 1))
        return let(starts, lambda p: F.zip_with(p, ends(p), lambda a, z: F.struct(
            F.get(s, a - 1).alias("term"), (z - a).cast("long").alias("tf"))))

    return F.when(F.size(terms) > 0, let(F.sort_array(terms), of))


def term_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, term, tf) of (key, terms). A row's terms are counted in the row and do not move; only rows whose
    key is repeated meet by key and term."""
    again = materialize(docs.groupBy(key).count().where("count > 1").select(F.col(key).alias("_key"), F.lit(True).alias("_again")), "again")
    marked = docs.join(again, docs[key].eqNullSafe(again["_key"]), "left")
    counted = marked.select(key, "_again", F.explode(_runs(F.col("terms"))).alias("c")).select(key, "_again", "c.*")
    if again.isEmpty():
        return counted.select(key, "term", "tf")
    shared = counted.where("_again").groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    return counted.where("_again is null").select(key, "term", "tf").unionByName(shared)


def _in_few(docs: DataFrame) -> DataFrame:
    """``docs``, of which, unless the session sets another number, ``BATCH_ROWS`` rows go to Python at once: Spark's own
    10,000 documents would be as large as their texts are long."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(conf.get(name)) == 10_000:
        conf.set(name, str(BATCH_ROWS))
    return docs


def _slices(incoming: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of at most ``SLICE_TERMS`` terms."""
    limit = limit or SLICE_TERMS
    for batch in incoming:
        ends = np.cumsum(batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, count) of every distinct term of every row, in order, and the terms by code."""
    column = batch.column("terms")
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = column.flatten().dictionary_encode()
    size = max(1, len(coded.dictionary))
    cell = np.repeat(np.arange(batch.num_rows), lengths) * size + coded.indices.to_numpy(zero_copy_only=False)
    cell, count = np.unique(cell, return_counts=True)
    row, code = np.divmod(cell, size)
    return row, code, count, coded.dictionary


def vocabulary(docs: DataFrame, min_df: int = 3, max_features: int | None = 50_000) -> DataFrame:
    """(term, n, df): terms in at least ``min_df`` documents, the ``max_features`` most frequent
    by corpus count, ties by term; None keeps them all. ``docs``: (doc_id, terms array<string>).

    Terms are counted inside each batch of documents, so only a batch's distinct terms leave Python,
    with both counts. Before the final sort a histogram of the counts (16 steps per doubling) rules out
    the terms that cannot be among the first ``max_features``, so that sort does not grow with the number
    of terms.
    """
    def count(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(incoming):
            _, code, n, terms = _cells(batch)
            total = np.bincount(code, n, len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [terms, pa.array(total), pa.array(np.bincount(code, minlength=len(terms)).astype(np.int64))], names=["term", "n", "df"])

    totals = (_in_few(docs).select("terms").mapInArrow(count, "term string, n long, df long").where("term is not null")
              .groupBy("term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")).where(F.col("df") >= min_df))
    if max_features is None:
        return totals
    totals = materialize(totals, "terms")
    step = F.floor(F.log2("n") * 16)
    lowest, above = 0, 0
    for row in totals.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        lowest, above = row["step"], above + row["count"]
        if above >= max_features:
            break
    return totals.where(step >= lowest).orderBy(F.desc("n"), "term").limit(max_features)


@dataclass
class Tfidf:
    """A fitted vocabulary as a table (term_idx, term, df, idf), term_idx dense in the order of the terms."""

    table: DataFrame
    size: int

    @cached_property
    def _local(self) -> pa.Table:
        if self.size > LOCAL_TERMS:
            raise ValueError(f"a vocabulary of {self.size} terms stays distributed")
        return self.table.select("term_idx", "term", "idf").toArrow().sort_by("term_idx")

    @property
    def terms(self) -> list[str]:
        return self._local["term"].to_pylist()

    @property
    def idf(self) -> np.ndarray:
        return self._local["idf"].to_numpy()


def fit_tfidf(docs: DataFrame, min_df: int = 3, max_features: int | None = 50_000) -> Tfidf:
    vocab = materialize(vocabulary(docs, min_df, max_features), "vocabulary")
    size, n = vocab.count(), docs.count()
    idf = F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1
    table = dense_index(vocab, ["term"], "term_idx", rows=size).select("term_idx", "term", "df", idf.alias("idf"))
    return Tfidf(materialize(table, "vocabulary"), size)


def tfidf(docs: DataFrame, fitted: Tfidf, key: str = "doc_id", local_terms: int = LOCAL_TERMS) -> DataFrame:
    """Weights (1 + ln tf) * idf, L2-normalised: (key, indices, values), indices ascending.

    Counting a document's terms needs no shuffle: a document is one row. A vocabulary of up to
    ``local_terms`` is sent to the tasks. Beyond, documents (whose ``key`` must be unique) emit their
    cells: the ``local_terms`` terms in most documents are weighted at once, the rest in a join by term,
    where no term is frequent any more.
    """
    if fitted.size > local_terms:
        return _joined_tfidf(docs, fitted, key, local_terms)
    held = docs.sparkSession.sparkContext.broadcast((fitted.terms, fitted.idf))
    key_type = arrow_type(docs, key)

    def run(incoming):
        terms, idf = held.value
        known = pa.array(terms, pa.string())
        for batch in _slices(incoming):
            rows, code, tf, own = _cells(batch)
            found = pc.index_in(own, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)[code]
            rows, found, tf = rows[found >= 0], found[found >= 0], tf[found >= 0]
            order = np.lexsort((found, rows))
            rows, found, tf = rows[order], found[order], tf[order]
            weights = (1 + np.log(tf)) * idf[found]
            norms = np.sqrt(np.bincount(rows, weights * weights, minlength=batch.num_rows))
            weights = weights / norms[rows]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))])
            offsets = pa.array(offsets.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).cast(key_type),
                 pa.ListArray.from_arrays(offsets, pa.array(found.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(weights))],
                names=[key, "indices", "values"])

    return _in_few(docs).select(key, "terms").mapInArrow(run, _sparse_schema(docs, key))


def _sparse_schema(docs: DataFrame, key: str) -> T.StructType:
    return T.StructType([docs.schema[key], T.StructField("indices", T.ArrayType(T.IntegerType())),
                         T.StructField("values", T.ArrayType(T.DoubleType()))])


def _joined_tfidf(docs: DataFrame, fitted: Tfidf, key: str, local_terms: int) -> DataFrame:
    spark = docs.sparkSession
    frequent = fitted.table.orderBy(F.desc("df"), "term_idx").limit(local_terms).select("term", "term_idx", "idf")  # bounded by the limit
    frequent = materialize(frequent, "frequent")
    table = frequent.toArrow()
    held = spark.sparkContext.broadcast((table["term"].combine_chunks(), table["term_idx"].to_numpy(), table["idf"].to_numpy()))
    key_type = arrow_type(docs, key)

    def run(incoming):
        known, index, idf = held.value
        for batch in _slices(incoming):
            rows, code, tf, own = _cells(batch)
            at = pc.index_in(own, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)[code]
            common = at >= 0
            weight = 1 + np.log(tf)
            weight[common] *= idf[at[common]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows)).cast(key_type),
                 pa.array(np.where(common, "", own.take(pa.array(code)).to_numpy(zero_copy_only=False)), pa.string()),
                 pa.array(np.where(common, index[at], -1)), pa.array(weight)],
                names=[key, "term", "term_idx", "weight"])

    schema = T.StructType([docs.schema[key], T.StructField("term", T.StringType()), T.StructField("term_idx", T.LongType()),
                           T.StructField("weight", T.DoubleType())])
    cells = materialize(_in_few(docs).select(key, "terms").mapInArrow(run, schema), "cells")
    rare = fitted.table.join(frequent.select("term_idx"), "term_idx", "left_anti").select("term", F.col("term_idx").alias("at"), "idf")
    weighted = (cells.where("term_idx < 0").join(rare, "term")
                .select(key, F.col("at").alias("term_idx"), (F.col("weight") * F.col("idf")).alias("weight")))
    weighted = cells.where("term_idx >= 0").select(key, "term_idx", "weight").unionByName(weighted)
    # a document's cells meet; it has as many as distinct terms
    packed = weighted.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term_idx", "weight"))).alias("c"),
                                       F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    whole = docs.select(key).join(packed, key, "left")
    empty = F.array()
    return whole.select(
        key, F.coalesce(F.transform("c", lambda c: c["term_idx"].cast("int")), empty.cast("array<int>")).alias("indices"),
        F.coalesce(F.transform("c", lambda c: c["weight"] / F.col("norm")), empty.cast("array<double>")).alias("values"))


def tfidf_weights(docs: DataFrame, fitted: Tfidf, key: str = "doc_id") -> DataFrame:
    """Long form (key, term, weight)."""
    sparse = tfidf(docs, fitted, key)
    cells = sparse.select(key, F.explode(F.arrays_zip("indices", "values")).alias("c"))
    cells = cells.select(key, F.col("c.indices").cast("long").alias("term_idx"), F.col("c.values").alias("weight"))
    terms = fitted.table.select("term_idx", "term")
    terms = F.broadcast(terms) if fitted.size <= MAX_BROADCAST_ROWS else terms
    return cells.join(terms, "term_idx").select(key, "term", "weight")


@dataclass
class Lsa:
    """``axes``: (terms, k) as a matrix, or as a table of blocks where the vocabulary is large."""

    axes: np.ndarray | BlockFactor
    singular_values: np.ndarray


def _gram_times(sparse: DataFrame, q: np.ndarray) -> np.ndarray:
    """X'X q for the sparse rows X: one pass, each task adding up its own rows.

    The partial sums travel in ranges of terms, summed in two rounds so that no group holds more
    than about the square root of the number of tasks.
    """
    held = sparse.sparkSession.sparkContext.broadcast(q)
    width = q.shape[1]
    span = max(1, (1 << 20) // (8 * width))  # terms per range, about 1 MB

    def partial(incoming):
        from pyspark import TaskContext

        q = held.value
        total = np.zeros(q.shape)
        for batch in incoming:
            rows, terms = ragged(batch.column("indices"))
            weights = batch.column("values").flatten().to_numpy(zero_copy_only=False)
            bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
                at, w = terms[start:stop], weights[start:stop]
                total[at] += w[:, None] * (w @ q[at])
        task = TaskContext.get().partitionId()
        starts = [s for s in range(0, len(total), span) if total[s:s + span].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(starts, pa.int32()), pa.array([task] * len(starts), pa.int32()),
             pa.array([total[s:s + span].tobytes() for s in starts], pa.binary())],
            names=["range", "task", "block"])

    def add(key, group):
        total = sum(np.frombuffer(b.as_py()) for b in group["block"])
        return pa.table({"range": pa.array([key[0].as_py()], pa.int32()),
                         "task": pa.array([0], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    schema = "range int, task int, block binary"
    parts = sparse.select("indices", "values").mapInArrow(partial, schema)
    if sparse.rdd.getNumPartitions() > FEW_TASKS:
        level = F.floor(F.sqrt(F.col("task"))).cast("int")
        parts = parts.withColumn("task", level).groupBy("range", "task").applyInArrow(add, schema)
    out = np.zeros(q.shape)
    for row in parts.groupBy("range").applyInArrow(add, schema).collect():
        block = np.frombuffer(row["block"]).reshape(-1, width)
        out[row["range"]:row["range"] + len(block)] = block
    return out


def _projected_gram(sparse: DataFrame, basis: np.ndarray) -> np.ndarray:
    """(X basis)'(X basis): one pass, each task sends width x width numbers."""
    held = sparse.sparkSession.sparkContext.broadcast(basis)
    width = basis.shape[1]

    def partial(incoming):
        from pyspark import TaskContext

        basis = held.value
        total = np.zeros((width, width))
        for batch in incoming:
            y = _rows_times(batch, basis)
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         names=["task", "block"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b) for b in group["block"].to_pylist())
        return pa.table({"task": pa.array([0], pa.int32()), "block": pa.array([total.tobytes()], pa.binary())})

    schema = "task int, block binary"
    parts = sparse.select("indices", "values").mapInArrow(partial, schema).withColumn("task", F.floor(F.sqrt("task")).cast("int"))
    sums = parts.groupBy("task").applyInArrow(add, schema).collect()  # about the square root of the tasks
    return sum((np.frombuffer(r["block"]) for r in sums), np.zeros(width * width)).reshape(width, width)


def _rows_times(batch: pa.RecordBatch, m: np.ndarray) -> np.ndarray:
    """The batch's sparse rows times a dense matrix."""
    rows, terms = ragged(batch.column("indices"))
    weights = batch.column("values").flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((batch.num_rows, m.shape[1]))
    bounds = np.searchsorted(rows, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        at = slice(bounds[i], bounds[i + 1])
        out[i] = weights[at] @ m[terms[at]]
    return out


def fit_lsa(sparse: DataFrame, terms: int, dim: int, passes: int = 3, oversample: int = 10,
            seed: int = 42, local_bytes: int = LOCAL_FACTOR_BYTES) -> Lsa:
    """Truncated SVD of the (uncentred) weights, ``dim`` at most terms - 1, by a randomised block Krylov
    basis: the blocks of every pass together hold the answer, so few passes do. Each pass reads the rows
    once. A factor (terms x width) of up to ``local_bytes`` is sent to the tasks, and one basis of passes + 1
    factors at the end; beyond, the factor stays a table of term blocks (``factor.py``), iterated twice as
    often, and only width x width reaches the driver."""
    sparse = _in_few(sparse)
    dim = max(1, min(dim, terms - 1))
    width = min(terms, dim + oversample)
    if terms * width * 8 > local_bytes:
        return Lsa(*fit_blocks(sparse, terms, dim, width, 2 * passes, seed))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    q = basis
    for _ in range(passes):
        z = _gram_times(sparse, q)
        for _ in range(2):
            z -= basis @ (basis.T @ z)
        q = np.linalg.qr(z)[0]
        basis = np.linalg.qr(np.hstack([basis, q]))[0]
    values, vectors = np.linalg.eigh(_projected_gram(sparse, basis))
    top = np.argsort(-values)[:dim]
    axes = basis @ vectors[:, top]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Lsa(axes * np.where(signs == 0, 1, signs), np.sqrt(np.maximum(values[top], 0)))


def lsa_scores(sparse: DataFrame, fitted: Lsa, key: str = "doc_id") -> DataFrame:
    """Documents on the latent axes, not normalised: (key, v array<double>)."""
    sparse = _in_few(sparse)
    if isinstance(fitted.axes, BlockFactor):
        return score_blocks(sparse, fitted.axes, key)
    held = sparse.sparkSession.sparkContext.broadcast(fitted.axes)
    key_type = arrow_type(sparse, key)

    def run(incoming):
        axes = held.value
        for batch in incoming:
            if not batch.num_rows:
                continue
            scores = _rows_times(batch, axes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).cast(key_type), vector_column(scores)], names=[key, "v"])

    schema = T.StructType([sparse.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))])
    return sparse.mapInArrow(run, schema)


def explained_variance(sparse: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: variance held by the (unnormalised) scores over the variance of the weights."""
    n = F.lit(sparse.count())

    def total(cells: DataFrame) -> DataFrame:
        moments = cells.groupBy("at").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        return moments.agg(F.sum(F.col("q") / n - (F.col("s") / n) * (F.col("s") / n)).alias("t"))

    zipped = F.arrays_zip("indices", "values")
    all_cells = sparse.select(F.explode(zipped).alias("c")).select(
        F.col("c.indices").alias("at"), F.col("c.values").alias("x"))
    kept = scores.select(F.posexplode("v").alias("at", "x"))
    return total(kept).select((F.col("t") / total(all_cells).scalar()).alias("explained"))


def lsa_embed(docs: DataFrame, dim: int = 256, min_df: int = 3, max_features: int | None = 50_000,
              key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Unit vectors from TF-IDF and truncated SVD, with their explained variance.

    ``docs``: (key, terms). Returns (key, v) and the one-row variance table.
    """
    docs = materialize(docs.select(key, "terms"), "terms")
    fitted = fit_tfidf(docs, min_df, max_features)
    sparse = materialize(tfidf(docs, fitted, key), "tfidf")
    lsa = fit_lsa(sparse, fitted.size, dim)
    raw = materialize(lsa_scores(sparse, lsa, key), "lsa")
    unit = raw.select(key, l2_normalize(F.col("v")).alias("v"))
    return unit, explained_variance(sparse, raw, key)
