"""Quality rules with isolation forests on their statistics (operator 9).

One pass over the whole texts gives each document's rule statistics. Fixed rules reject documents of
fewer than 50 words and those of which more than half the words lie in repeated 3-word windows. The others
are judged by the path lengths of random splits on the ratios of all statistics (RATIOS, unclipped): one
forest splits on all of them and gives `anomaly`, and one forest for each ratio splits on it alone, so that
a document that is odd in one respect is not hidden by others that are odd in several. A forest has TREES trees
of SAMPLE rows each. The rows of a tree are those with the smallest hash of tree and row over *all* documents
that pass the fixed rules; a threshold on the hash lets about twice as many through, whatever the corpus.

Thresholds are calibrated on all labelled rows, without the
fifth that is held out for figures (crc32 of doc_id divisible by 5). The forest whose threshold saves most
is taken first, then the next on what is left, until none saves anything; a rejected row of quality 1
costs GOOD_COST, a kept one of quality 0 costs 1. A forest that saves nothing rejects nothing. Without
labels of both kinds only `anomaly` above DEFAULT rejects. Every document is scored.

Words are runs outside 0x20 and 0x09-0x0D; null texts have none. All statistics of an empty text are 0 and
it is rejected by the fixed rules. A very long text is counted by itself, whole. Repeated rows are scored
alike and drawn together; rows without doc_id are judged but never calibrate. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, keep, mix, seq_hash, slices

TREES, SAMPLE, DEPTH = 100, 256, 8
STEPS = 4096  # equal parts of the scores, whose sums are added up first
GOOD_COST = 10
DEFAULT = 0.7
LEAST_WORDS = 50
SEED = 5

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_CAPITAL = np.zeros(256, np.int64)
_CAPITAL[65:91] = 1
_MARK = np.zeros(256, np.int64)
_MARK[[ord(c) for c in "!?@^~=+_{}[]\\/"]] = 1

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks", "n_distinct")
RATIOS = ("symbols", "dup_lines", "repeated", "word_length", "capitals", "marks", "variety")


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[offsets])


def counts(column: pa.Array):
    """(first row, array of COUNTS by row) of several rows at a time."""
    for lo, hi, data, offsets in slices(column):
        words, n = Words(data, offsets), hi - lo
        point = (data & 0xC0) != 0x80
        in_word = np.zeros(len(data) + 1, np.int64)
        np.add.at(in_word, words.starts, 1)
        np.add.at(in_word, words.ends, -1)
        chars = _sums(point & (np.cumsum(in_word[:-1]) > 0), offsets)
        # lines with a word, by the bytes of the line
        breaks = np.flatnonzero(data == 10)
        starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], breaks + 1]))
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        ends = np.where((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(data) else ends
        has = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
        row = np.searchsorted(offsets, starts, "right") - 1
        line = mix(seq_hash(data.astype(np.uint64) + np.uint64(1), starts, ends) + (ends - starts).astype(np.uint64))
        row, line = row[has], line[has]
        lines = np.bincount(row, minlength=n)
        distinct = np.unique(mix(line ^ mix(row.astype(np.uint64))), return_index=True)[1]
        dup = lines - np.bincount(row[distinct], minlength=n)
        # words in repeated windows of three
        h, total = words.hash, len(words.hash)
        covered = np.zeros(total, bool)
        if total >= 3:
            at = np.flatnonzero(words.rows[:-2] == words.rows[2:])
            window = mix(seq_hash(h, at, at + 3) ^ mix(words.rows[at].astype(np.uint64) + np.uint64(77)))
            _, inverse, times = np.unique(window, return_inverse=True, return_counts=True)
            again = at[times[inverse] > 1]
            for step in range(3):
                covered[again + step] = True
        repeat = np.bincount(words.rows[covered], minlength=n)
        kinds = np.unique(mix(h ^ mix(words.rows.astype(np.uint64))), return_index=True)[1]
        yield lo, np.stack([
            words.counts, chars, _sums(_SYMBOL[data], offsets), dup, repeat, lines, _sums(_CAPITAL[data], offsets),
            _sums(_MARK[data], offsets), np.bincount(words.rows[kinds], minlength=n)], 1).astype(np.int64)


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS) per row of ``docs``."""

    def count(batches):
        for batch in batches:
            for lo, table in counts(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(table)), *(pa.array(table[:, i].copy()) for i in range(len(COUNTS)))],
                    ["doc_id", *COUNTS])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def inputs(table: np.ndarray) -> np.ndarray:
    """RATIOS from COUNTS. Variety is log distinct over log words, which hardly depends on the length."""
    words, chars, symbols, dup, repeat, lines, capitals, marks, distinct = table.T.astype(float)
    some, by = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([symbols / some, dup / np.maximum(lines, 1), repeat / some, chars / some, capitals / by, marks / some,
                     np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2))], 1)


@dataclass
class Forest:
    feature: np.ndarray  # tree x node of a full binary tree; -1 ends
    cut: np.ndarray
    path: np.ndarray  # path length where a node ends

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[rows, np.maximum(f, 0)] > cut[at]))
            total += path[at]
        return 2.0 ** (-total / max(len(self.feature), 1) / _average(SAMPLE))


class Steps:
    """A forest on one column: its score is the same between two neighbouring cuts."""

    def __init__(self, forest: Forest):
        self.cut = np.unique(forest.cut[forest.feature >= 0])
        self.value = forest.score(np.append(self.cut, np.inf)[:, None])

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.value[np.searchsorted(self.cut, x)]


@dataclass
class Model:
    whole: Forest
    single: list[Steps]
    threshold: np.ndarray  # of the whole forest, then of each of RATIOS

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Row x forest, from COUNTS."""
        x = inputs(table)
        return np.stack([self.whole.score(x), *(f.score(x[:, i]) for i, f in enumerate(self.single))], 1)


def _average(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(drawn: list[np.ndarray], seed: int = SEED) -> Forest:
    """One tree of random splits on the rows of each of ``drawn``."""
    rng, nodes, trees = np.random.default_rng(seed), 2 ** (DEPTH + 1) - 1, len(drawn)
    feature, cut, path = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t, x in enumerate(drawn):
        todo = [(0, 0, x)]
        while todo:
            node, depth, rows = todo.pop()
            if depth == DEPTH or len(rows) < 2 or not len(open_ := np.flatnonzero(rows.max(0) > rows.min(0))):
                path[t, node] = depth + _average(len(rows))
                continue
            f = feature[t, node] = int(rng.choice(open_))
            low, high = rows[:, f].min(), rows[:, f].max()
            c = rng.uniform(low, high)
            if not low <= c < high:  # rounded to the edge
                c = low
            cut[t, node], right = c, rows[:, f] > c
            todo += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return Forest(feature, cut, path)


def failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > 50 * n_words)


def _matrix(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in COUNTS], 1) if table.num_rows else np.empty((0, len(COUNTS)), np.int64)


def draw(passing: DataFrame, trees: int = TREES, size: int = SAMPLE) -> list[np.ndarray]:
    """COUNTS of the rows of each tree: the ``size`` with the smallest hash of tree and row."""
    n, surplus = passing.count(), 2
    while n:
        top = min(2**63 - 1, -2**63 + (surplus * size << 64) // n)
        rows = passing.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "doc_id", *COUNTS).select(
            "tree", F.xxhash64("tree", "doc_id", *COUNTS).alias("u"), *COUNTS).where(F.col("u") <= top)
        rows = rows.toArrow()  # about trees * size * surplus rows, whatever the table
        tree, table = rows["tree"].to_numpy(), _matrix(rows)
        if np.bincount(tree, minlength=trees).min() >= min(size, n):
            order = np.lexsort([*table.T, rows["u"].to_numpy(), tree])
            cuts = np.searchsorted(tree[order], np.arange(trees))
            return [table[order[a: a + size]] for a in cuts]
        surplus *= 2
    return []


def fit(stats: DataFrame, labels: DataFrame) -> Model:
    passing = stats.where(~failed(F.col("n_words"), F.col("n_repeat_words")))
    drawn = [inputs(table) for table in draw(passing)]
    model = Model(grow(drawn), [Steps(grow([x[:, [i]] for x in drawn], SEED + 1 + i)) for i in range(len(RATIOS))],
                  np.array([DEFAULT] + [np.inf] * len(RATIOS)))
    usable = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(
        F.max("quality").cast("long").alias("y"))
    known = passing.join(usable, "doc_id").select("doc_id", *COUNTS, "y").distinct()
    held, names = stats.sparkSession.sparkContext.broadcast(model), [f"s{i}" for i in range(len(RATIOS) + 1)]

    def score(batches):
        for batch in batches:
            scores = held.value.scores(np.stack([batch.column(c).to_numpy() for c in COUNTS], 1))
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in scores.T), batch.column("y")], [*names, "y"])

    scored = known.select(*COUNTS, "y").mapInArrow(score, ", ".join(f"{c} double" for c in names) + ", y long")
    model.threshold = calibrated(keep(scored, "scores"), names)
    return model


def held_out() -> Column:
    """Labelled rows that never calibrate."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def best_cuts(scored: DataFrame, names: list[str]) -> dict[int, tuple[int, float]]:
    """Of each of the columns ``names``, (what it saves, threshold) of the threshold that saves most: a bad row above it
    saves 1, a good one costs GOOD_COST. It lies half-way between scores; of equal ones the highest is taken. Rows of equal
    score are added up first, then the parts of the scores, so no window takes more than a part of the distinct ones."""
    worth = F.when(F.col("y") == 0, 1).when(F.col("y") == 1, -GOOD_COST).otherwise(0)
    cells = scored.select(worth.alias("w"), F.posexplode(F.array(*names)).alias("forest", "score"))
    at = keep(cells.groupBy("forest", "score").agg(F.sum("w").alias("w")).withColumn("part", F.floor(F.col("score") * STEPS)), "cells")
    down = Window.partitionBy("forest").orderBy(F.desc("part"))
    parts = at.groupBy("forest", "part").agg(F.sum("w").alias("sum"), F.min("score").alias("low")).select(
        "forest", "part", F.sum("sum").over(down.rowsBetween(Window.unboundedPreceding, -1)).alias("over"),
        F.lag("low").over(down).alias("next"))  # at most STEPS + 1 a forest
    inside = Window.partitionBy("forest", "part").orderBy(F.desc("score"))
    above = F.coalesce(F.sum("w").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.coalesce("over", F.lit(0))
    cuts = at.join(F.broadcast(parts), ["forest", "part"]).select(
        "forest", "score", above.alias("saved"), F.coalesce(F.lag("score").over(inside), "next").alias("next"))
    best = cuts.groupBy("forest").agg(F.max(F.struct("saved", "score", "next")).alias("b")).select("forest", "b.*").collect()
    return {r["forest"]: (r["saved"], np.inf if r["next"] is None else (r["score"] + r["next"]) / 2) for r in best}


def calibrated(scored: DataFrame, names: list[str]) -> np.ndarray:
    """A threshold for each of the columns ``names``; infinite where it saves nothing beyond those taken before."""
    out = np.full(len(names), np.inf)
    kinds = {r["y"] for r in scored.select("y").where("y in (0, 1)").distinct().collect()}
    if kinds != {0, 1}:
        out[0] = DEFAULT
        return out
    while cuts := best_cuts(scored, names):
        saved, cut, column = max((saved, cut, -i) for i, (saved, cut) in cuts.items())
        if saved <= 0:
            break
        out[-column] = min(out[-column], cut)
        scored = scored.where(F.col(names[-column]) <= F.lit(float(out[-column])))
    return out


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS, base_failed, anomaly, kept) per row of ``docs``."""
    stats = keep(statistics(docs), "statistics")
    fitted = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))  # TREES * 511 nodes and as many steps a ratio

    def judge(batches):
        for batch in batches:
            model = fitted.value
            scores = model.scores(np.stack([batch.column(c).to_numpy() for c in COUNTS], 1))
            bad = failed(batch.column("n_words").to_numpy(), batch.column("n_repeat_words").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(bad), pa.array(scores[:, 0]), pa.array(~bad & (scores <= model.threshold).all(1))],
                [*batch.schema.names, "base_failed", "anomaly", "kept"])

    return stats.mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
                            + ", base_failed boolean, anomaly double, kept boolean")
