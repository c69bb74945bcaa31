"""Filter interaction audit with wide packed counters (operator 12).

Filters fail or pass a document on their own; in which order they run decides which filter removes it.
For every order of the filters and every step the audit counts what is kept, removed and redundant.

A document is the mask of the filters that it fails. Every mask maps to one integer of 3 counters for
each (order, step), 600 steps for five filters: kept there, removed there, failing there but removed
earlier. A task adds up its documents' integers per part, once for all documents, once for the good ones
and once for the toxic ones; the sums of the tasks are added in two rounds. A counter is as wide as the
number of all rows needs, so no sum carries into the next one. Unpacked, step 5 of the orders that end
with a filter holds the documents that only this filter fails, and the sum over all orders of what a
filter removes is its Shapley value times the number of orders.

The text filters: A under 100 words, B less than 80 % distinct words, C more than 10 % of ``[A-Z]``, D
any of ``#$%&*|``, E the same text under a smaller doc_id. Texts are compared by SHA-256. Rows of equal
text are counted per (part, labels) before they meet, so a group of copies is a few rows, however large.

Null and empty texts are one text and fail A only; a null doc_id is neither smaller nor larger than any,
so such a row never fails E and makes none fail. Null and empty lang are one part. A repeated doc_id is as
many rows; labels repeated for one doc_id count as 1 if any row says 1, null labels as 0. Texts may be of
any length, the words of one text are in memory at once. An empty table has no parts and no rows. Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import salted_lookup
from .common import keep

FILTERS = "ABCDE"
PARTS_HELD = 4096  # parts that a task adds up at once
COUNTERS = 3  # kept, removed, redundant
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_SUMS = "part string, task int, everything binary, good binary, toxic binary"


def steps(n: int) -> list[tuple[tuple[int, ...], int]]:
    """(order, step from 0) of every field, in order."""
    return [(order, at) for order in permutations(range(n)) for at in range(n)]


def packed_outcomes(n: int, width: int) -> list[int]:
    """The integer of every mask; a counter has ``width`` bytes."""
    packed = []
    for mask in range(1 << n):
        value = bytearray()
        for order, at in steps(n):
            removed_before = any(mask >> f & 1 for f in order[:at])
            fails = mask >> order[at] & 1
            for one in (not fails and not removed_before, fails and not removed_before, fails and removed_before):
                value += int(one).to_bytes(width, "little")
        packed.append(int.from_bytes(value, "little"))
    return packed


def unpacked(total: bytes, width: int) -> np.ndarray:
    """(fields, 3) counters of a sum."""
    raw = np.frombuffer(total, np.uint8).reshape(-1, COUNTERS, width)
    wide = np.zeros((*raw.shape[:2], 8), np.uint8)
    wide[..., :width] = raw
    return wide.view("<u8")[..., 0].astype(np.int64)


def text_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) with the bits of the filters A to D."""
    t = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), t.alias("t"))
    read = read.withColumn("w", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    n, distinct, length = F.size("w"), F.size(F.array_distinct("w")), F.char_length("t")
    capitals = length - F.char_length(F.translate("t", CAPITALS, ""))
    tests = [n < 100, F.lit(100) * distinct < F.lit(80) * n, F.lit(100) * capitals > F.lit(10) * length,
             F.col("t").rlike(r"[#$%&*|]")]
    mask = sum((F.when(test, 1 << at).otherwise(0) for at, test in enumerate(tests)), F.lit(0))
    return read.select("doc_id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), mask.alias("mask"))


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """(part, mask, good, toxic, n) of rows (doc_id, part, digest, mask, good, toxic), ``bit`` set in the
    mask of rows that repeat the digest of a smaller doc_id."""
    group = ["digest", "part", "mask", "good", "toxic"]
    ids = rows.groupBy(*group, "doc_id").agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    unknown = F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unknown")
    ids = keep(ids.groupBy(*group).agg(F.sum("n").alias("n"), first, unknown), "same-text")
    least = ids.groupBy("digest").agg(F.min("first.doc_id").alias("least"))
    met = ids.join(least, "digest")
    original = F.col("unknown") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), original.alias("n")),
                   F.struct(F.col("mask").bitwiseOR(F.lit(1 << bit)).alias("mask"), (F.col("n") - original).alias("n")))
    return met.select("part", "good", "toxic", F.inline(both)).where("n > 0")


def _adder(n: int, width: int):
    fields = len(steps(n)) * COUNTERS * width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = packed_outcomes(n, width)
        task = TaskContext.get().partitionId()
        held: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            sums = [[x[k].to_bytes(fields, "little") for x in held.values()] for k in range(3)]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([task] * len(held), pa.int32()), *[pa.array(x, pa.binary()) for x in sums]],
                names=["part", "task", "everything", "good", "toxic"])

        for batch in batches:
            for part, mask, good, toxic, count in zip(*(batch.column(c).to_pylist() for c in ("part", "mask", "good", "toxic", "n")), strict=True):
                if part not in held and len(held) == PARTS_HELD:
                    yield flush()
                    held = {}
                sums = held.setdefault(part, [0, 0, 0])
                value = packed[mask] * count
                sums[0] += value
                sums[1] += value * good
                sums[2] += value * toxic
        if held:
            yield flush()

    return run


def _added(key: tuple, group: pa.Table) -> pa.Table:
    out = {"part": [key[0].as_py()], "task": pa.array([0], pa.int32())}
    for name in ("everything", "good", "toxic"):
        values = group[name].to_pylist()
        total = sum(int.from_bytes(v, "little") for v in values)
        out[name] = pa.array([total.to_bytes(len(values[0]), "little")], pa.binary())
    return pa.table(out)


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The interaction table of rows (part, mask, good, toxic, n): per (part, filter_order, step) the
    counts kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    n = len(filters)
    rows = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    width = max(1, -(-int(rows).bit_length() // 8))
    sums = counted.mapInArrow(_adder(n, width), _SUMS)
    spread = F.floor(F.sqrt("task")).cast("int")
    sums = sums.withColumn("task", spread).groupBy("part", "task").applyInArrow(_added, _SUMS)

    def unpack(key: tuple, group: pa.Table) -> pa.Table:
        total = _added(key, group)
        everything, good, toxic = (unpacked(total[name][0].as_py(), width) for name in ("everything", "good", "toxic"))
        fields = steps(n)
        at = np.array([order[step] for order, step in fields])
        last = np.array([step == n - 1 for _, step in fields])
        shapley = np.bincount(at, everything[:, 1], n).astype(np.int64)
        only = np.array([everything[last & (at == f), 1].max() for f in range(n)])
        names = ["".join(filters[f] for f in order) for order, _ in fields]
        return pa.table({
            "part": pa.array([key[0].as_py()] * len(fields), pa.string()), "filter_order": names,
            "step": pa.array([step + 1 for _, step in fields], pa.int32()), "kept": everything[:, 0], "removed": everything[:, 1],
            "redundant": everything[:, 2], "unique_fails": only[at], "good_lost": good[:, 1], "toxic_lost": toxic[:, 1],
            "shapley": shapley[at]})

    return sums.groupBy("part").applyInArrow(
        unpack, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
                "good_lost long, toxic_lost long, shapley long")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction table of the five text filters."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).where("doc_id is not null")
    rows = salted_lookup(text_masks(docs), marks, "doc_id", hot=[]).select(
        "doc_id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return audit(keep(with_copies(rows, FILTERS.index("E")), "masks"))
