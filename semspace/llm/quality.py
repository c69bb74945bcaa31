"""Quality score by a factorisation machine (operator 3).

Inputs of the score are the text and its length in the table (metadata): presence of hashed words,
scaled to unit length, and standardised structure statistics. Every input i has a weight and RANK
factors; the pairwise term of all inputs is half of (sum v_i x_i)^2 - sum (v_i x_i)^2 by factor, so a
document is scored in time linear in its words. Labels, lang, source and doc_id are never inputs.

Fitting takes a bounded sample: the MAX_ROWS labelled rows with the smallest hash of doc_id whose crc32 of
doc_id mod 5 is not 0 (the rest is held out). Their features go to the driver (at most MAX_ROWS rows), which
runs EPOCHS (LEAST_STEPS steps at least) of mini-batch AdaGrad on the logistic loss, in a fixed order. Scoring covers all whole
texts, with the model (2^15 + 24 inputs) broadcast.

Null and empty texts have no words and are scored from their statistics. Where a document has several
labels, the largest counts. Without usable labels the score is 0.5, with labels of one kind their mean. A null
length counts as 0. Repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, slices

SPACE = 1 << 15
RANK = 6
MAX_ROWS = 12_000
EPOCHS, LEAST_STEPS = 4, 400
BATCH = 256
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.3

_CLASS = np.zeros((256, 8), np.float32)  # letters, capitals, digits, marks, bars, stops, line ends, bytes >= 128
_CLASS[[*range(65, 91), *range(97, 123)], 0] = 1
_CLASS[65:91, 1] = 1
_CLASS[48:58, 2] = 1
_CLASS[[ord(c) for c in "#*$%&<>@^~=+_{}[]\\/!?"], 3] = 1
_CLASS[ord("|"), 4] = 1
_CLASS[[ord(c) for c in ".,;:"], 5] = 1
_CLASS[10, 6] = 1
_CLASS[128:, 7] = 1
N_STATS = 20


@dataclass
class Model:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features(column: pa.Array, n_chars: np.ndarray):
    """(first row, row of each word input, its index, statistics by row) of several rows at a time."""
    for lo, hi, data, offsets in slices(column):
        words = Words(data, offsets)
        n, size = hi - lo, np.diff(offsets).astype(np.float64)
        key = np.unique(words.rows * SPACE + (words.hash & np.uint64(SPACE - 1)).astype(np.int64))
        row = key // SPACE
        distinct = np.bincount(row, minlength=n)
        sums = np.stack([np.bincount(np.repeat(np.arange(n), np.diff(offsets)), _CLASS[:, c][data], n) for c in range(8)], 1)
        length = np.bincount(words.rows, words.ends - words.starts, n)
        square = np.bincount(words.rows, (words.ends - words.starts) ** 2.0, n)
        count = words.counts.astype(np.float64)
        marked = np.bincount(words.rows, _CLASS[:, 3][data[words.ends - 1]] if len(data) else None, n)
        capital = np.bincount(words.rows, _CLASS[:, 1][data[words.starts]] if len(data) else None, n)
        pairs, pair = words.shingles(3)
        same = np.bincount(np.unique(pairs * (1 << 40) + (pair & np.uint64((1 << 40) - 1)).astype(np.int64)) >> 40, minlength=n)
        some, by = np.maximum(count, 1), np.maximum(size, 1)
        mean = length / some
        stats = np.stack([
            *(sums[:, c] / by for c in range(8)), np.log1p(count), np.log1p(size), np.log1p(np.nan_to_num(n_chars[lo:hi])),
            distinct / some, mean, np.sqrt(np.maximum(square / some - mean ** 2, 0)), marked / some, capital / some,
            same / np.maximum(count - 2, 1), sums[:, 6] / some, sums[:, 5] / some, count == 0], 1)
        yield lo, row, key % SPACE, stats


def _inputs(row: np.ndarray, n: int) -> np.ndarray:
    """Values of word inputs: unit length per row."""
    return 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))[row]


def _sum(row: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums by row of the columns of ``values``; rows ascend."""
    if not len(row):
        return np.zeros((n, values.shape[1]))
    total = np.zeros((n, values.shape[1]))
    head = np.flatnonzero(np.diff(row, prepend=-1))
    total[row[head]] = np.add.reduceat(values, head, axis=0)
    return total


def _forward(m: Model, row, index, x, dense, n):
    """(raw score, factor sums) of n rows."""
    vx = m.v[index] * x[:, None]
    vd = m.v[SPACE:]
    sums = _sum(row, vx, n) + dense @ vd
    squares = _sum(row, vx ** 2, n).sum(1) + (dense ** 2) @ (vd ** 2).sum(1)
    linear = _sum(row, (m.w[index] * x)[:, None], n)[:, 0] + dense @ m.w[SPACE:]
    return m.w0 + linear + 0.5 * ((sums ** 2).sum(1) - squares), sums


def _standard(m: Model, stats: np.ndarray) -> np.ndarray:
    return np.clip((stats - m.mean) / m.scale, -4, 4) / np.sqrt(N_STATS)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(labelled: pa.Table) -> Model:
    """From columns y, at (list of word inputs), stats, in their order."""
    n = labelled.num_rows
    y = labelled["y"].to_numpy().astype(float) if n else np.empty(0)
    rng = np.random.default_rng(7)
    m = Model(0.0, np.zeros(SPACE + N_STATS), rng.normal(0, 0.02, (SPACE + N_STATS, RANK)), np.zeros(N_STATS), np.ones(N_STATS))
    if n == 0 or y.min() == y.max():
        share = y.mean() if n else 0.5
        m.w0, m.v = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -20, 20)), m.v * 0
        return m
    at = labelled["at"].combine_chunks()
    starts, flat = at.offsets.to_numpy(), at.flatten().to_numpy()
    stats = labelled["stats"].combine_chunks().flatten().to_numpy().reshape(n, N_STATS)
    m.mean, m.scale = stats.mean(0), np.maximum(stats.std(0), 1e-6)
    dense = _standard(m, stats)
    m.w0 = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv = np.full(SPACE + N_STATS, 1e-6), np.full((SPACE + N_STATS, RANK), 1e-6)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-n // BATCH)))):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo: lo + BATCH]
            size = starts[pick + 1] - starts[pick]
            row = np.repeat(np.arange(len(pick)), size)
            index = flat[np.repeat(starts[pick] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            x = _inputs(row, len(pick))
            z, sums = _forward(m, row, index, x, dense[pick], len(pick))
            g = (_sigmoid(z) - y[pick]) / len(pick)
            m.w0 -= RATE * float(g.sum())
            used, place = np.unique(index, return_inverse=True)
            gx = g[row] * x
            words_w = np.bincount(place, gx, len(used)) + DECAY * m.w[used]
            vi = m.v[index]
            each = gx[:, None] * (sums[row] - vi * x[:, None])
            words_v = np.stack([np.bincount(place, each[:, f], len(used)) for f in range(RANK)], 1) + DECAY * m.v[used]
            d, vd = dense[pick], m.v[SPACE:]
            stats_w = d.T @ g + DECAY * m.w[SPACE:]
            stats_v = (d * g[:, None]).T @ sums - vd * ((d ** 2).T @ g)[:, None] + DECAY * vd
            touched = np.concatenate([used, np.arange(SPACE, SPACE + N_STATS)])
            dw, dv = np.concatenate([words_w, stats_w]), np.concatenate([words_v, stats_v])
            gw[touched] += dw ** 2
            gv[touched] += dv ** 2
            m.w[touched] -= RATE * 4 * dw / np.sqrt(gw[touched])
            m.v[touched] -= RATE * dv / np.sqrt(gv[touched])
    return m


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model from ``labels`` (doc_id, quality), see the module's text."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    text = docs.select("doc_id", "text", _length(docs))
    rows = text.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "n_chars", "y")  # max_rows rows at most

    def extract(batches):
        for batch in batches:
            n_chars = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            for lo, row, index, stats in features(batch.column(1), n_chars):
                n = len(stats)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, n), batch.column(3).slice(lo, n),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(index.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * N_STATS), pa.array(stats.ravel()))],
                    ["doc_id", "y", "at", "stats"])

    got = rows.mapInArrow(extract, "doc_id long, y int, at array<int>, stats array<double>").toArrow()
    return fit(got.sort_by([("doc_id", "ascending"), ("y", "ascending")]).combine_chunks())


def _length(docs: DataFrame):
    return (F.coalesce(F.col("n_chars"), F.lit(0)) if "n_chars" in docs.columns else F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("n_chars")


def score_column(m: Model, column: pa.Array, n_chars: np.ndarray) -> np.ndarray:
    out = np.empty(len(column))
    for lo, row, index, stats in features(column, n_chars):
        n = len(stats)
        z, _ = _forward(m, row, index, _inputs(row, n), _standard(m, stats), n)
        out[lo: lo + n] = _sigmoid(z)
    return out


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(row, score): ``row`` is a struct of all columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SPACE * (RANK + 1) doubles, whatever the data
    base = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").alias("text"), _length(docs))

    def score(batches):
        for batch in batches:
            n_chars = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score_column(shared.value, batch.column(1), n_chars))], ["row", "score"])

    return base.mapInArrow(score, T.StructType([base.schema["row"], T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    narrow = docs.select("doc_id", "text", *[c for c in ["n_chars"] if c in docs.columns])
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = narrow.select("doc_id", "text", _length(docs))

    def score(batches):
        for batch in batches:
            n_chars = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score_column(shared.value, batch.column(1), n_chars))], ["doc_id", "score"])

    out = base.mapInArrow(score, T.StructType([base.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of THRESHOLD or more."""
    return scored(docs, train(docs, labels)).where(F.col("score") >= THRESHOLD).select("row.*")
