"""Corpus-wide line de-duplication by a deletion-neighbourhood join (operator 6).

Lines are split at newlines; a line is its words, A-Z lowered. Every line with a word takes part. Two lines
are equal if their words are. They are near if one edit (insert, delete, replace) turns one into the other:
between lines of at least NEAR_WORDS words an edit of a word, between shorter lines an edit of a character of
the words joined by single spaces, where both have at least NEAR_CHARS characters (in fewer, one character
tells lines apart: numbers, marks of lists; their edit bound is 0). A line goes if an equal line comes
earlier, or if its words are near a line whose first occurrence is earlier than its own first; order is
(doc_id, hash of the text, line number). So the earliest of any pair stays unless a still earlier line is
near it. The result depends on the rows alone.

1. Every line becomes two 64-bit hashes; equal lines are combined before the shuffle.
2. *Lossless prefilter.* One edit leaves the first or the last half of a line alone. Each distinct line
   emits the hashes of both; only lines that share one with another line go on.
3. *Deletion neighbourhood.* Each of them emits all variants within the edit bound as hashed keys: the line
   with unit i (word or character) deleted, keyed with i for replacements and without it for insertions, and
   the line itself. Equal variants are joined through their earliest line, so a variant that thousands of
   lines share costs a row each and no pairs.
4. The edit distance of each match is verified on the units.

A line that repeats very often is a hot key of the last join; the HOT_LINES most frequent lines are joined
by broadcast, so that a line left to the shuffle holds at most 1/HOT_LINES of the rows.

Null and empty texts have no lines; a very long text is split by itself, whole. Rows that repeat with equal
doc_id and text are one document: none removes lines of the other. A null doc_id comes first in the order.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, Words, bitmap, in_bitmap, keep, mix, seq_hash, slices

NEAR_WORDS = 8
NEAR_CHARS = 16
HOT_LINES = 4096

_B = np.uint64(0x5851F42D4C957F2D)
_PREFIX, _SUFFIX, _COUNT = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_AT = np.uint64(0xA0761D6478BD642F)
_CHAR = np.uint64(0xE7037ED1A0B428DB)


class _Lines:
    """Lines with words of several rows: row, number in the row, word range, two hashes, and the units that an
    edit changes: the hashes of the words, or of the characters of a short line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=True)
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        number = breaks[words.starts] - breaks[offsets[words.rows]]
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (words.rows[1:] != words.rows[:-1])
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], len(number))
        self.row, self.number, self.m = words.rows[lo], number[lo], hi - lo
        count = self.m.astype(np.uint64)
        self.a = mix(seq_hash(words.hash, lo, hi) + count)
        self.b = mix(seq_hash(mix(words.hash ^ _B), lo, hi) + count)
        short = self.m < NEAR_WORDS
        chars, sizes = _characters(data, words, lo, hi, short)
        self.unit = np.concatenate([words.hash, chars])
        self.lo, self.hi = lo.copy(), hi.copy()
        self.hi[short] = len(words.hash) + np.cumsum(sizes)
        self.lo[short] = self.hi[short] - sizes
        self.n = self.hi - self.lo
        self.near = ~short | (self.n >= NEAR_CHARS)

    def halves(self) -> list[np.ndarray]:
        """Hashes of the first and last c units, for both c that a line has in common with lines that are
        one unit shorter, equally long or one unit longer."""
        out = []
        for c in ((self.n - 1) // 2, self.n // 2):
            tag = c.astype(np.uint64) * _COUNT
            out.append(mix(seq_hash(self.unit, self.lo, self.lo + c) + tag + _PREFIX))
            out.append(mix(seq_hash(self.unit, self.hi - c, self.hi) + tag + _SUFFIX))
        return out


def _characters(data: np.ndarray, words: Words, lo: np.ndarray, hi: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the characters of the short lines, characters of each): words joined by a space."""
    first, last = lo[short], hi[short] - 1
    use = np.repeat(short, hi - lo)  # by word
    inner = use.copy()
    inner[last] = False  # the byte after such a word is a separator of its line
    step = np.zeros(len(data) + 1, np.int64)
    step[words.starts[use]] += 1
    step[words.ends[use]] -= 1
    taken = np.cumsum(step[:-1]) > 0
    taken[words.ends[inner]] = True
    text = data.copy()
    text[words.ends[inner]] = 32
    text = np.where((text >= 65) & (text <= 90), text + 32, text).astype(np.uint8)
    begins = np.concatenate([[0], np.cumsum(taken & ((data & 0xC0) != 0x80))])
    points = np.frombuffer(text[taken].tobytes().decode().encode("utf-32-le"), "<u4")
    return mix(points.astype(np.uint64) ^ _CHAR), begins[words.ends[last]] - begins[words.starts[first]]


def _long(x: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64), mask=null)


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line, m, a, b, k0..k3) of all lines with a word; h: the text's hash, k0..k3 null where the
    edit bound is 0."""

    def split(batches):
        for batch in batches:
            for lo, _, data, offsets in slices(batch.column(1)):
                t = _Lines(data, offsets)
                rows = pa.array(t.row + lo)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(t.number.astype(np.int32)),
                     pa.array(t.m.astype(np.int32)), _long(t.a), _long(t.b), *(_long(x, ~t.near) for x in t.halves())],
                    ["doc_id", "h", "line", "m", "a", "b", "k0", "k1", "k2", "k3"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(
        split, "doc_id long, h long, line int, m int, a long, b long, k0 long, k1 long, k2 long, k3 long")


def _half_shared(distinct: DataFrame) -> DataFrame:
    """(a) of lines that share a half with another line."""
    keys = distinct.where("k0 is not null").select(
        "a", F.explode(F.array_distinct(F.array("k0", "k1", "k2", "k3"))).alias("k"))
    shared = keys.groupBy("k").count().where("count > 1").select("k")
    return keys.join(shared, "k", "left_semi").select("a").distinct()


def _units_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(a, b, first, w): the units of chosen distinct lines, read at their first occurrence."""
    ids = bitmap(chosen.select(F.pmod(F.xxhash64("first.doc_id"), F.lit(BITMAP_BITS)).alias("at")))
    lines = bitmap(chosen.select(F.pmod("a", F.lit(BITMAP_BITS)).alias("at")))

    def read(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(ids.value, batch.column(3).to_numpy(zero_copy_only=False))))
            for lo, _, data, offsets in slices(batch.column(1)):
                t = _Lines(data, offsets)
                at = t.a.view(np.int64) & (BITMAP_BITS - 1)
                use = np.flatnonzero(t.near & in_bitmap(lines.value, at))
                rows = pa.array(t.row[use] + lo)
                ends = np.concatenate([[0], np.cumsum(t.n[use])])
                unit = np.repeat(t.lo[use] - ends[:-1], t.n[use]) + np.arange(ends[-1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(t.number[use].astype(np.int32)),
                     _long(t.a[use]), _long(t.b[use]),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _long(t.unit[unit]))],
                    ["doc_id", "h", "line", "a", "b", "w"])

    found = docs.select("doc_id", "text", F.xxhash64("text").alias("h"),
                        F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).alias("at")).mapInArrow(
        read, "doc_id long, h long, line int, a long, b long, w array<long>")
    first = F.struct("doc_id", "h", "line")
    return found.withColumn("first", first).join(chosen.select("a", "b", "first"), ["a", "b", "first"], "left_semi").select(
        "a", "b", "first", "w").dropDuplicates(["a", "b"])


def _variants(lines: DataFrame) -> DataFrame:
    """(v, kind, a, b): kind 0 a replacement key, 1 the line itself, 2 a line less one unit."""

    def spread(batches):
        for batch in batches:
            w = batch.column(2)
            n = np.diff(w.offsets.to_numpy())
            word = np.asarray(w.flatten()).view(np.uint64)
            hi = np.cumsum(n)
            lo = hi - n
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(word))
            whole = seq_hash(word, lo, hi)
            head = seq_hash(word, lo[row], at)
            tail = seq_hash(word, at + 1, hi[row])
            i = (at - lo[row]).astype(np.uint64)
            # the hash of the line without unit i: what follows moves up by one
            less = head + tail * _powers(i)
            count = n.astype(np.uint64)
            gone = mix(less + (count[row] - np.uint64(1)))
            itself = mix(whole + count)
            place = mix(gone ^ mix(i + _AT))
            rows = np.concatenate([row, np.arange(len(n)), row])
            kind = np.concatenate([np.zeros(len(row), np.int32), np.ones(len(n), np.int32), np.full(len(row), 2, np.int32)])
            v = np.concatenate([place, itself, gone])
            yield pa.RecordBatch.from_arrays([_long(v), pa.array(kind), batch.column(0).take(pa.array(rows)),
                                              batch.column(1).take(pa.array(rows))], ["v", "kind", "a", "b"])

    return lines.select("a", "b", "w").mapInArrow(spread, "v long, kind int, a long, b long")


def _powers(i: np.ndarray) -> np.ndarray:
    """The base of ``seq_hash`` to the power of each i."""
    steps = np.full(int(i.max()) + 1 if len(i) else 1, np.uint64(0x9E3779B97F4A7C15), np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)[i.astype(np.int64)]


def _within_one(x: pa.Array, y: pa.Array) -> np.ndarray:
    """For each pair of rows of two list columns whether at most one unit inserted, deleted or replaced turns
    one into the other: what they share at both ends must cover all but one unit of the longer."""
    a, b = (np.asarray(c.flatten()) for c in (x, y))
    n, m = (np.diff(c.offsets.to_numpy()).astype(np.int64) for c in (x, y))
    lo, lo2 = np.cumsum(n) - n, np.cumsum(m) - m
    least, row = np.minimum(n, m), np.repeat(np.arange(len(n)), np.minimum(n, m))
    step = np.arange(len(row)) - np.repeat(np.cumsum(least) - least, least)
    shared = []
    for differ in (a[lo[row] + step] != b[lo2[row] + step], a[(lo + n)[row] - 1 - step] != b[(lo2 + m)[row] - 1 - step]):
        first = least.copy()
        np.minimum.at(first, row[differ], step[differ])
        shared.append(first)
    longer = np.maximum(n, m)
    return (np.abs(n - m) <= 1) & (shared[0] + shared[1] >= longer - 1)


def near_lines(docs: DataFrame, distinct: DataFrame) -> DataFrame:
    """(a, b, near): distinct lines with the earliest of the lines near them that precede them."""
    chosen = keep(distinct.join(_half_shared(distinct), "a", "left_semi").where("k0 is not null").select(
        "a", "b", "first"), "chosen")
    lines = keep(_units_of(docs, chosen), "words")
    keys = _variants(lines)
    # kinds 1 and 2 meet each other, kind 0 meets itself
    met = keys.groupBy("v").agg(F.count("*").alias("n"), F.min("kind").alias("k0"), F.max("kind").alias("k1"))
    met = met.where("n > 1 and (k1 = 0 or k0 = 1 and k1 = 2)").select("v")
    keys = keep(keys.join(met, "v", "left_semi").join(lines.select("a", "b", "first"), ["a", "b"]), "variants")
    least = keys.groupBy("v", "kind").agg(F.min(F.struct("first", "a", "b")).alias("least"))
    other = least.select("v", F.when(F.col("kind") == 1, 2).when(F.col("kind") == 2, 1).otherwise(0).alias("kind"), "least")
    matches = keys.join(other, ["v", "kind"]).where(F.col("least.first") < F.col("first"))
    matches = matches.select("a", "b", F.col("least.a").alias("a2"), F.col("least.b").alias("b2"),
                             F.col("least.first").alias("near")).distinct()
    words = lines.select("a", "b", "w")
    pairs = matches.join(words, ["a", "b"]).join(words.select(
        F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("w").alias("w2")), ["a2", "b2"])

    def check(batches):
        for batch in batches:
            yield batch.select(["a", "b", "near"]).filter(pa.array(_within_one(batch.column("w"), batch.column("w2"))))

    found = pairs.select("a", "b", "near", "w", "w2").mapInArrow(
        check, "a long, b long, near struct<doc_id:bigint,h:bigint,line:int>")
    return found.groupBy("a", "b").agg(F.min("near").alias("near"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, line, n_words, kind, first_doc_id, first_line): every line that goes, kind equal or near,
    with the earlier line it goes for."""
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    lines = keep(line_table(docs), "lines")
    at = F.struct("doc_id", "h", "line")
    distinct = keep(lines.groupBy("a", "b").agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("times"), *(F.min(c).alias(c) for c in ("m", "k0", "k1", "k2", "k3"))), "distinct")
    near = keep(near_lines(docs, distinct), "near")
    hit = keep(distinct.join(near, ["a", "b"], "left").where("near is not null or first < last").select(
        "a", "b", "first", "near", "times"), "hit")
    hot = keep(hit.orderBy(F.desc("times"), "a", "b").limit(HOT_LINES), "hot")
    rows = lines.select("doc_id", "h", "line", "m", "a", "b")
    found = rows.join(F.broadcast(hot), ["a", "b"]).unionByName(
        rows.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(hit, ["a", "b"]))
    gone = found.withColumn("equal", at > F.col("first")).where("equal or near is not null")
    cause = F.when(F.col("near").isNull() | F.col("equal") & (F.col("first") < F.col("near")), F.col("first")).otherwise(F.col("near"))
    return gone.select("doc_id", "h", "line", F.col("m").alias("n_words"),
                       F.when(F.col("equal"), F.lit("equal")).otherwise(F.lit("near")).alias("kind"), cause.alias("cause")).select(
        "doc_id", "h", "line", "n_words", "kind", F.col("cause.doc_id").alias("first_doc_id"),
        F.col("cause.line").alias("first_line")).distinct()


def without_removed(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines of ``removed_lines`` taken out of text, n_chars counted anew. Documents that
    lose all their words go; documents that had none stay."""
    gone = removed_lines(docs).groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(
        F.collect_set("line").alias("_lines"))  # at most the lines of one document
    at = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    joined = at.join(gone, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    parts = F.split(F.col("row.text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "_lines")
    text = F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n")
    new = F.when(F.col("_lines").isNotNull(), text).otherwise(F.col("row.text"))
    out = joined.select("row", "_lines", new.alias("new")).where(F.col("_lines").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col("new")} | ({"n_chars": F.when(F.col("_lines").isNull(), F.col("row.n_chars")).otherwise(
        F.length("new")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"row.{c}").alias(c) for c in docs.columns))
