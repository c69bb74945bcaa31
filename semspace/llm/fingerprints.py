"""Exact duplicates by an exchange of Golomb-coded fingerprints (operator 11).

Two texts are equal when they are identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted.

1. *Senders.* One pass over the texts leaves, per row, its SHA-256 and length. Rows are cut into chunks
   of bounded size; a chunk reduces its digests to fingerprints of log2(rows) + 10 bits, sorts them,
   drops repeats and sends each owner of a range of fingerprints one Rice-coded list of gaps: about
   log2(gap) + 1.5 bits a row instead of 32 bytes.
2. *Owners* decode and merge the lists of their range, which holds a bounded number of fingerprints, and
   return a bitmap per list: which of its fingerprints another chunk sent too. However large a group of
   copies, an owner sees its fingerprint once per chunk.
3. *Suspects* are the rows with a bit set or with a repeat inside their own chunk. Only they are grouped,
   by digest, and only the texts of digests that occur twice are shuffled, each at most once per task, to
   be compared byte by byte. Which texts are read again is decided by a bitmap of fixed size, which lets
   more through when it fills up, never fewer. If texts of one digest differ, its rows are grouped by the
   texts themselves.

Of a group the row with the longest original text (code points) stays, then the smallest doc_id, rows
without a doc_id last; of wholly equal rows one stays, an arbitrary one. A null text counts as empty, so
empty, null and blank texts are one group. Texts may be of any length: none is cut, and none is ever in
Python. An empty table gives an empty result. Further columns are not read; ``deduplicated`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import HOT_KEYS, HOT_ROWS, salted_lookup
from .common import keep

CHUNK_ROWS = 1 << 18
OWNER_HASHES = 1 << 22  # fingerprints that an owner merges, at most about
LEAST_OWNERS = 64
SPARE_BITS = 10  # one row in a thousand is suspected for nothing
FILTER_BITS = 1 << 23

_TABLE = pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("slot", pa.int32()), ("repeat", pa.bool_()),
                    ("row", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("digest", pa.binary()),
                    ("hashes", pa.int32()), ("low_bits", pa.int32()), ("code", pa.binary())])
_TABLE_SQL = ("chunk long, owner int, slot int, repeat boolean, row long, doc_id long, size long, digest binary, "
              "hashes int, low_bits int, code binary")


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def golomb_encode(values: np.ndarray, low_bits: int) -> bytes:
    """Ascending distinct integers as gaps: all quotients in unary, then all remainders of ``low_bits``."""
    gaps = np.diff(values, prepend=0).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(low_bits)).astype(np.int64) + 1)
    unary = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    unary[ends - 1] = 1
    shifts = np.arange(low_bits - 1, -1, -1, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.concatenate([unary, low.ravel()])).tobytes()


def golomb_decode(code: bytes, n: int, low_bits: int) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(code, np.uint8))
    ends = np.flatnonzero(bits[: len(bits) - n * low_bits])[:n] if n else np.empty(0, np.int64)
    stop = ends[-1] + 1 if n else 0
    high = np.diff(ends, prepend=-1) - 1
    low = bits[stop: stop + n * low_bits].reshape(n, low_bits).astype(np.int64)
    low = low @ (np.int64(1) << np.arange(low_bits - 1, -1, -1, dtype=np.int64)) if low_bits else np.zeros(n, np.int64)
    return np.cumsum((high.astype(np.int64) << low_bits) + low)


def rice_bits(span: int, n: int) -> int:
    """Bits of the remainder that suit ``n`` values spread over ``span``."""
    return max(0, int(span * 0.69 / max(1, n)).bit_length() - 1)


def _layout(rows: int) -> tuple[int, int]:
    """(bits of a fingerprint, bits of its owner)."""
    owners = max(LEAST_OWNERS, -(-rows // OWNER_HASHES))
    owner_bits = (owners - 1).bit_length()
    return max(owner_bits, rows.bit_length() + SPARE_BITS), owner_bits


def _sender(bits: int, owner_bits: int, chunk_rows: int):
    inside = bits - owner_bits

    def chunk(parts: list[pa.RecordBatch], number: int) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        n = rows.num_rows
        prints = (rows["h"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(prints, kind="stable")
        values, first, counts = np.unique(prints[order], return_index=True, return_counts=True)
        owners = values >> inside
        starts = np.flatnonzero(np.diff(owners, prepend=-1))
        begin = np.repeat(starts, np.diff(np.append(starts, len(values))))
        slots = np.empty(n, np.int32)
        owner, repeat = np.empty(n, np.int32), np.empty(n, bool)
        slots[order] = np.repeat(np.arange(len(values)) - begin, counts)
        owner[order], repeat[order] = np.repeat(owners, counts), np.repeat(counts > 1, counts)
        ids = pa.array(np.full(n, number), pa.int64())
        none = pa.nulls(n, pa.int32())
        at = pa.array(number * chunk_rows + np.arange(n), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(owner), pa.array(slots), pa.array(repeat), at, rows["doc_id"].combine_chunks(),
             rows["size"].combine_chunks(), rows["digest"].combine_chunks().cast(pa.binary()), none, none, pa.nulls(n, pa.binary())], schema=_TABLE)
        lists = []
        for start, stop in zip(starts, np.append(starts, len(values))[1:], strict=True):
            own = values[start:stop] & ((1 << inside) - 1)
            low = rice_bits(1 << inside, len(own))
            lists.append((int(owners[start]), len(own), low, golomb_encode(own, low)))
        m = len(lists)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, number), pa.int64()), pa.array([x[0] for x in lists], pa.int32()), pa.nulls(m, pa.int32()),
             pa.nulls(m, pa.bool_()), *[pa.nulls(m, pa.int64())] * 3, pa.nulls(m, pa.binary()),
             pa.array([x[1] for x in lists], pa.int32()), pa.array([x[2] for x in lists], pa.int32()),
             pa.array([x[3] for x in lists], pa.binary())], schema=_TABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows = TaskContext.get().partitionId() << 20, [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, chunk_rows - rows)
                batch, rows = batch.slice(part.num_rows), rows + part.num_rows
                held.append(part)
                if rows == chunk_rows:
                    yield from chunk(held, number)
                    number, held, rows = number + 1, [], 0
        if rows:
            yield from chunk(held, number)

    return run


def _owner(lists: pa.Table) -> pa.Table:
    """For each list of one owner, which of its fingerprints occur in another list: words of 64 bits."""
    counts = lists["hashes"].to_numpy()
    coded = zip(lists["code"].to_pylist(), counts, lists["low_bits"].to_numpy(), strict=True)
    values = np.concatenate([golomb_decode(code, int(n), int(low)) for code, n, low in coded])
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    twice = np.zeros(len(values), np.uint8)
    twice[order[1:][same]], twice[order[:-1][same]] = 1, 1
    words, found, stop = [], [], 0
    for at, n in enumerate(counts):
        own, stop = twice[stop: stop + n], stop + n
        if own.any():
            found.append(at)
            words.append(np.packbits(np.pad(own, (0, -n % 64)), bitorder="little").view(np.int64))
    return pa.table({"chunk": lists["chunk"].take(pa.array(found, pa.int64())), "owner": lists["owner"].take(pa.array(found, pa.int64())),
                     "words": pa.array(words, pa.list_(pa.int64()))})


def suspects(docs: DataFrame, digest: Callable[[Column], Column] = sha256, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(row, doc_id, size, digest, suspect) of every row; rows that are no suspects have no copy."""
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
                        digest(normalised(F.col("text"))).alias("digest"))
    light = light.select("*", F.xxhash64("digest").alias("h"))
    bits, owner_bits = _layout(docs.count())
    sent = keep(light.mapInArrow(_sender(bits, owner_bits, chunk_rows), _TABLE_SQL), "fingerprints")
    lists = sent.where("code is not null").select("chunk", "owner", "hashes", "low_bits", "code")
    replies = lists.groupBy("owner").applyInArrow(_owner, "chunk long, owner int, words array<long>")
    rows = sent.where("code is null").drop("hashes", "low_bits", "code")
    bit = F.getbit(F.get("words", F.expr("slot div 64").cast("int")), F.col("slot") % 64)
    flagged = rows.join(replies, ["chunk", "owner"], "left").select(
        "row", "doc_id", "size", "digest", (F.col("repeat") | F.coalesce(bit == 1, F.lit(False))).alias("suspect"))
    return keep(flagged, "suspects")


def _best() -> Column:
    """Order of preference inside a group, as the largest struct; ``~x`` turns the order of x around."""
    return F.max(F.struct("size", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("not_id"),
                          F.bitwise_not("row").alias("not_row"))).alias("best")


def _verdict(rows: DataFrame) -> DataFrame:
    """``rows`` with the (group_size, best) of their group, both null for a row without a copy."""
    alone = F.col("group_size").isNull()
    return rows.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.bitwise_not("best.not_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.bitwise_not("row") == F.col("best.not_row"))).alias("kept"), "digest", "size", "row")


def _texts(docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column], *columns: str) -> DataFrame:
    """Normalised texts whose digest may be in ``groups``, after a bitmap of ``FILTER_BITS``."""
    at = F.pmod(F.xxhash64(F.lit(11), F.col("digest")), F.lit(FILTER_BITS))
    words = (groups.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits")))  # at most FILTER_BITS / 64 rows
    read = docs.select(*columns, normalised(F.col("text")).alias("norm"))
    read = read.withColumn("digest", digest(F.col("norm"))).withColumn("at", at).withColumn("word", F.expr("at div 64"))
    return (read.join(F.broadcast(words), "word").where("getbit(bits, int(at % 64)) = 1")
            .select(*columns, "digest", "norm"))


def labelled(docs: DataFrame, digest: Callable[[Column], Column] = sha256, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, digest, size, row): one row per document, ``row`` numbers them."""
    rows = suspects(docs, digest, chunk_rows)
    suspected = rows.where("suspect")
    groups = keep(suspected.groupBy("digest").agg(F.count("*").alias("group_size"), _best()).where("group_size > 1"), "groups")
    texts = _texts(docs, groups, digest, "text").select("digest", "norm").distinct()
    unequal = keep(texts.groupBy("digest").count().where("count > 1").select("digest"), "unequal")
    hot = [(r["digest"], -(-r["group_size"] // HOT_ROWS)) for r in
           groups.where(F.col("group_size") > HOT_ROWS).orderBy(F.desc("group_size")).limit(HOT_KEYS).collect()]
    grouped = salted_lookup(suspected, groups, "digest", "left", hot=hot) if hot else suspected.join(groups, "digest", "left")
    alone = rows.where("not suspect").select("*", F.lit(None).cast("long").alias("group_size"),
                                             F.lit(None).cast(groups.schema["best"].dataType).alias("best"))
    result = alone.unionByName(grouped)
    if unequal.isEmpty():
        return _verdict(result)
    # a digest that stands for several texts: its rows are grouped by the texts
    again = _texts(docs.select("doc_id", "text"), unequal, digest, "doc_id", "text").join(unequal, "digest", "left_semi")
    again = keep(again.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", "norm",
                              F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"),
                              F.bitwise_not(F.monotonically_increasing_id()).alias("row")), "by-text")
    by_text = again.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), _best())
    again = again.join(by_text, ["digest", "norm"]).withColumn("suspect", F.lit(True)).select(result.columns)
    return _verdict(result.join(unequal, "digest", "left_anti").unionByName(again))


def exact_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    return labelled(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns. Rows that share a doc_id and a text are one."""
    stays = labelled(docs).where("kept").select("doc_id", "digest", "size").toDF("_id", "_digest", "_size")
    marked = docs.withColumn("_own", sha256(normalised(F.col("text")))).withColumn(
        "_length", F.char_length(F.coalesce("text", F.lit(""))))
    same = (F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest"))
            & (F.col("_length") == F.col("_size")))
    return marked.join(stays, same, "left_semi").dropDuplicates(["doc_id", "_own"]).drop("_own", "_length")
