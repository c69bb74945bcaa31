"""Mixture-controlled packing of token streams by deficit round-robin (operator 4).

Each source is a queue: its documents' ids, each document followed by the separator, in a fixed order.
Round-robin gives a queue a quantum of about its target share of a window per round; what a queue is
owed below a whole quantum stays its deficit for the next window. ``targets`` weighs the sources; without it
they weigh as much as they hold, so all queues end together. Every id is packed either way: when a queue is
empty the others go on in their own proportions, and sources that ``targets`` leaves out or weighs 0 follow
after all others, by their sizes.

The schedule has a closed form, which is what carries deficits across windows *and* partitions without
a sequential pass: quantum j of queue q falls due at (j + 1/2) * quantum_q / weight_q, and the number of
quanta of any other queue that are due before it needs only that queue's weight and total. So every task
computes the places of its own documents, all tasks agree, and only one total per queue is gathered.
``deficits`` tells per window what each queue is still owed.

Only the MAX_QUEUES most frequent sources and those of ``targets`` have queues of their own; the others share
SHARED_QUEUES queues by hash, so in the windows these keep the proportions of the shared queues only.

The stream of quanta is cut into windows. All are full but the last one, whose rest is cut into sequences
of descending powers of two: nothing is padded.

Null or empty texts are the separator alone. Repeated rows are packed each. A null source is a queue of
its own. An empty table gives no pieces. Only doc_id, text and source are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep
from .tokens import default_path, encoder

WINDOW = 4096
SEPARATOR = 2
LEAST_QUANTUM = 128
MAX_QUEUES, SHARED_QUEUES = 1000, 24
CELLS = 1 << 16
BLOCK = 4096  # windows whose running sums are made in one task

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, queue int")


def queues(docs: DataFrame, source: str, targets: dict | None = None) -> dict:
    """source -> queue of the at most MAX_QUEUES most frequent sources and of the sources of ``targets``."""
    top = docs.groupBy(source).count().orderBy(F.desc("count"), source).limit(MAX_QUEUES).collect()
    named = {row[0]: i for i, row in enumerate(top)}
    for name in targets or {}:
        named.setdefault(name, MAX_QUEUES + SHARED_QUEUES + len(named))
    return named


def encoded(docs: DataFrame, path: str, separator: int, source: str, named: dict) -> DataFrame:
    """(doc_id, queue, part, start, n, ids): a document's ids with the separator, and its place in the
    stream of its queue within this part."""
    schema = "doc_id long, queue int, part int, start long, n long, ids binary"

    def encode(batches):
        part, done = TaskContext.get().partitionId(), {}
        for batch in batches:
            names = batch.column(2).to_pylist()
            for lo, ids, offsets in encoder(path).rows(batch.column(1)):
                rows = len(offsets) - 1
                ids = np.insert(ids, offsets[1:], np.uint32(separator))
                offsets = offsets + np.arange(rows + 1)
                queue, start = np.empty(rows, np.int32), np.empty(rows, np.int64)
                for i, n in enumerate(np.diff(offsets).tolist()):
                    name = names[lo + i]
                    q = named.get(name)
                    if q is None:
                        q = MAX_QUEUES + zlib.crc32(str(name).encode()) % SHARED_QUEUES
                    queue[i], start[i] = q, done.get(q, 0)
                    done[q] = int(start[i]) + n
                small = ids.astype("<u2") if len(ids) == 0 or ids.max() < 65536 else None
                width = 2 if small is not None else 4
                data = (small if small is not None else ids.astype("<u4")).tobytes()
                # the width is told by the length: bytes / n
                binary = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), rows, [None, pa.py_buffer((offsets * width).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, rows), pa.array(queue), pa.array(np.full(rows, part, np.int32)),
                     pa.array(start), pa.array(np.diff(offsets)), binary.cast(pa.binary())],
                    ["doc_id", "queue", "part", "start", "n", "ids"])
        encoder(path).clear()  # the process goes on to other tasks

    return docs.select("doc_id", "text", source).mapInArrow(encode, schema)


class Schedule:
    """Places of quanta in the merged stream, from the totals of the queues and their weights."""

    def __init__(self, totals: dict[int, int], window: int = WINDOW, least: int = LEAST_QUANTUM,
                 weights: dict[int, float] | None = None):
        self.window = window
        self.queues = np.array(sorted(totals), np.int64)
        self.totals = np.array([totals[q] for q in self.queues.tolist()], np.int64)
        self.total = int(self.totals.sum())
        self.weight, self.offset = self.totals.astype(np.float64), np.zeros(len(self.queues))
        share = self.totals / max(self.total, 1)
        if weights is not None:
            given = np.array([weights.get(q, 0.0) for q in self.queues.tolist()], np.float64)
            named = given > 0
            for group in (named, ~named):  # each group's shares are its own
                w = np.where(group, given if group is named else self.totals, 0)
                share = np.where(group, w / max(w.sum(), 1e-300), share)
            if named.any():  # the named queues end by time 1, the others run from 2 to 3
                given *= (self.totals[named] / given[named]).max()
                self.weight = np.where(named, given, self.weight)
                self.offset = np.where(named, 0.0, 2.0)
        self.quantum = np.clip(np.rint(share * window).astype(np.int64), min(least, window), window)
        self.count = -(-self.totals // self.quantum)
        rest, at, cuts = self.total % window, self.total - self.total % window, []
        for bit in reversed(range(window.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                cuts.append(at)
        self.full = self.total // window
        self.tail = np.array(cuts, np.int64)

    def due(self, k: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.offset[k] + (j + 0.5) * self.quantum[k] / self.weight[k]

    def place(self, k: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Tokens before quantum ``j`` of the k-th queue, a bounded number of cells (quantum, other queue) at a time."""
        place, other = np.empty(len(j), np.int64), np.arange(len(self.queues))[None, :]
        step = max(1, CELLS // len(self.queues))
        for lo in range(0, len(j), step):
            mine, own = k[lo: lo + step, None], j[lo: lo + step, None]
            when = self.due(mine, own)

            def before(n, mine=mine, when=when):
                due = self.due(other, n)
                return (due < when) | ((due == when) & (other < mine))

            n = np.clip((when - self.offset) * self.weight / self.quantum + 0.5, 0, self.count).astype(np.int64)
            for _ in range(3):
                n -= (n > 0) & ~before(n - 1)
            for _ in range(3):
                n += (n < self.count) & before(n)
            n = np.where(other == mine, own, n)
            place[lo: lo + step] = np.minimum(n * self.quantum, self.totals).sum(1)
        return place

    def owed(self, k: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Tokens that the k-th queue would have among the first ``place`` if they were dealt in exact proportion."""
        turns = np.unique(np.concatenate([self.offset, self.offset + self.totals / self.weight]))
        sums = np.clip((turns[:, None] - self.offset) * self.weight, 0, self.totals).sum(1)
        time = np.interp(place, sums, turns)
        return np.clip((time - self.offset[k]) * self.weight[k], 0, self.totals[k])

    def ends(self, sequence: np.ndarray) -> np.ndarray:
        """Tokens up to the end of each sequence."""
        tail = np.concatenate([self.tail, [self.total]])
        return np.where(sequence < self.full, (sequence + 1) * self.window, tail[np.clip(sequence - self.full, 0, len(tail) - 1)])

    def end(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, first place, end place) of the sequences at ``place``."""
        sequence = place // self.window
        first, end = sequence * self.window, (sequence + 1) * self.window
        if len(self.tail):
            late = sequence >= self.full
            i = np.minimum(np.searchsorted(self.tail, place, "right"), len(self.tail) - 1)
            starts = np.concatenate([[self.full * self.window], self.tail[:-1]])
            sequence = np.where(late, self.full + i, sequence)
            first, end = np.where(late, starts[i], first), np.where(late, self.tail[i], end)
        return sequence, first, end

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray):
        """(row, start in the document, length, sequence, offset) of documents that lie at
        [start, start + n) of their queues' streams, in the order of row and start."""
        k = np.searchsorted(self.queues, queue)
        quantum = self.quantum[k]
        first = start // quantum
        count = (start + n - 1) // quantum - first + 1
        row = np.repeat(np.arange(len(n)), count)
        j = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        lo = np.maximum(j * quantum[row], start[row])
        hi = np.minimum((j + 1) * quantum[row], (start + n)[row])
        place = self.place(k[row], j) + lo - j * quantum[row]
        at, left, found = lo - start[row], hi - lo, []
        while len(row):
            sequence, begin, end = self.end(place)
            take = np.minimum(left, end - place)
            found.append((row, at, take, sequence, place - begin))
            more = left > take
            row, at, left, place = row[more], (at + take)[more], (left - take)[more], (place + take)[more]
        if not found:
            return (np.empty(0, np.int64),) * 5
        row, at, length, sequence, offset = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, row))
        row, at, length, sequence, offset = (x[order] for x in (row, at, length, sequence, offset))
        new = np.ones(len(row), bool)  # neighbours that touch in one sequence are one piece
        new[1:] = (row[1:] != row[:-1]) | (sequence[1:] != sequence[:-1]) | (offset[1:] != (offset + length)[:-1])
        heads = np.flatnonzero(new)
        return row[heads], at[heads], np.add.reduceat(length, heads), sequence[heads], offset[heads]


def pack(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, window: int = WINDOW,
         source: str = "source", targets: dict | None = None) -> DataFrame:
    """One row per piece, see PIECES: doc_id, start and length in the document's ids, crc32 of the ids,
    the document's ids in all, sequence, offset there, queue. ``targets``: source -> weight, at most MAX_QUEUES."""
    return _packed(docs, path, separator, window, source, targets)[0]


def pack_with_deficits(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, window: int = WINDOW,
                       source: str = "source", targets: dict | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(pieces, deficits, source -> queue), see ``pack`` and ``deficits``; the pieces are written once."""
    pieces, plan, named = _packed(docs, path, separator, window, source, targets)
    pieces = keep(pieces, "pieces")
    return pieces, deficits(pieces, plan), named


def deficits(pieces: DataFrame, plan: Schedule) -> DataFrame:
    """(sequence_id, queue, tokens, deficit): tokens of a queue in a sequence, and what it is owed at the end of
    that sequence (negative: ahead of its share). A sequence without tokens of a queue has no row for it.

    Running sums are made in blocks of BLOCK sequences and over one row per block."""
    per = pieces.groupBy("sequence_id", "queue").agg(F.sum("length").alias("tokens")).withColumn("block", F.expr(f"sequence_id div {BLOCK}"))
    per = keep(per, "window-tokens")
    earlier = Window.partitionBy("queue").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = per.groupBy("queue", "block").agg(F.sum("tokens").alias("sum")).select(
        "queue", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("queue", "block").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, 0)
    running = per.join(blocks, ["queue", "block"]).select(
        "sequence_id", "queue", "tokens", (F.col("base") + F.sum("tokens").over(within)).alias("placed"))

    def owed(batches):
        for batch in batches:
            sequence, queue, _, placed = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            left = plan.owed(np.searchsorted(plan.queues, queue), plan.ends(sequence)) - placed
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(left)], ["sequence_id", "queue", "tokens", "deficit"])

    return running.mapInArrow(owed, "sequence_id long, queue int, tokens long, deficit double")


def _packed(docs: DataFrame, path: str | None, separator: int, window: int, source: str, targets: dict | None):
    if targets is not None and (len(targets) > MAX_QUEUES or not all(0 <= w < float("inf") for w in targets.values())):
        raise ValueError(f"targets: at most {MAX_QUEUES} sources with finite weights of 0 or more")
    named = queues(docs, source, targets)
    table = keep(encoded(docs, path or default_path(), separator, source, named), "encoded")
    parts = table.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = keep(parts.select("queue", "part", "tokens", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")), "parts")
    weights = None if targets is None else {named[name]: w for name, w in targets.items()}
    plan = Schedule({r[0]: r[1] for r in base.groupBy("queue").agg(F.sum("tokens")).collect()}, window, weights=weights)

    def cut(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            queue, start, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            row, at, length, sequence, offset = plan.pieces(queue, start, n)
            data = batch.column(4)
            crc = np.empty(len(row), np.int64)
            held, ids = -1, b""
            for i, (r, a, m) in enumerate(zip(row.tolist(), at.tolist(), length.tolist(), strict=True)):
                if r != held:
                    raw = data[r].as_buffer()
                    width = len(raw) // int(n[r])
                    held, ids = r, np.frombuffer(raw, f"<u{width}").astype("<u4").data.cast("B")
                crc[i] = zlib.crc32(ids[4 * a: 4 * (a + m)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(at), pa.array(length), pa.array(crc), pa.array(n[row]),
                 pa.array(sequence), pa.array(offset), pa.array(queue[row])],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])

    placed = table.join(base.select("queue", "part", "base"), ["queue", "part"])
    pieces = placed.select("doc_id", "queue", (F.col("start") + F.col("base")).alias("start"), "n", "ids").mapInArrow(cut, PIECES)
    return pieces, plan, named
