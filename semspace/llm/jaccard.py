"""Set-similarity join of word n-grams with set-relation skipping (operator 8).

Every document is the set of its distinct k-word shingles (64-bit hashes of the words' bytes, A-Z
lowered). Two sets link when 100 * |intersection| >= percent * |union|. The join is exact up to hash
collisions; it reports each document's component of the link graph, and loses no link between two
components. Steps:

1. *Order.* A bounded list of frequent shingles goes last in the order of tokens, the rest are ordered
   by hash. Any order gives right results; this one keeps frequent shingles out of the prefixes.
2. *Set relation, equal sets.* Documents with equal sets are one class; only its smallest id joins.
3. *Index.* The first |x| - ceil(percent * |x|) + 1 tokens of a set, with their positions, are its
   postings. Two sets that link share one of them. Lists are read in the order of set size, and a list
   with one entry goes no further.
4. *Set relation, similar sets.* Before any pair is made, every set is tied to one set: of each of its lists
   to the most central entry, whose postings stand in the longest lists, and of these to the one it shares
   most postings with. Ties are verified and merge their sets into groups; further rounds tie each set to
   entries of other groups, until nothing merges. A round is linear in the postings. From then on a set takes
   its group's answers: no pairs are made within a group, and a list whose entries all belong to one group is
   skipped as a block.
5. *Set relation, incremental answers.* Sets tied to the same centre c form a star. Of two of its sets
   |x n y| = |c| - |c - x| - |c - y| + |dx n dy| with dx the symmetric difference of x and c, so y answers x
   exactly if they share enough of the tokens in which they differ from c. Two sets that are not both linked
   to c must share at least one; those meet by prefixes of their differences, the rarest first, instead of
   the tokens that the whole star has in common.
   *Positions.* All other entries of different groups meet in their lists if sizes and positions still
   permit the overlap; the shared postings of a pair bound its overlap from above, and only pairs that can
   reach the threshold go on.
6. *Verification* on whole sets, which are kept once: first the best pair of each set among those that are
   not of one component yet, then all that are still left. A pair is skipped only if its sets are already
   connected by verified links.

Empty or null texts have the empty set: n_shingles 0, linked with nothing, their own component.
Rows with one doc_id are one vertex, whatever their texts; the result has one row per input row. Rows
without doc_id get the component of an equal set, if there is one, else null. No step gathers a list, a group or the documents in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BITMAP_BITS, Words, bitmap, components, in_bitmap, keep, mix, slices

HOT_LOCAL, HOT_GLOBAL = 1 << 15, 1 << 18  # frequent tokens reported by a task, and kept
LIKELY = 0.08  # share of a prefix that a tie has in common; it decides the work, not the result
NEAR = 60  # percent of similarity to the centre that makes a set part of its star
PLACES = 1 << 23  # of the bitmap that decides which sets travel to be verified
ROUNDS = 4  # of ties at most; what they leave apart the join compares
WORDS = 4
PERCENT = 85


def _sets(column: pa.Array, k: int):
    """(row, sorted distinct hashes) of each row."""
    for lo, hi, data, offsets in slices(column):
        rows, h = Words(data, offsets, lower=True).shingles(k)
        order = np.argsort(rows, kind="stable") if len(rows) and (np.diff(rows) < 0).any() else slice(None)
        rows, h = rows[order], h[order]
        cuts = np.searchsorted(rows, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            yield lo + i, np.unique(h[cuts[i]: cuts[i + 1]])


def frequent_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """At most HOT_GLOBAL frequent shingles, sorted: from every task its HOT_LOCAL most frequent ones."""

    def count(batches):
        for batch in batches:
            parts, held = [], 0
            for lo, hi, data, offsets in slices(batch.column(0)):
                parts.append(Words(data, offsets, lower=True).shingles(k)[1])
                held += len(parts[-1])
                if held > 1_000_000:
                    yield report(parts)
                    parts, held = [], 0
            if parts:
                yield report(parts)

    def report(parts):
        token, n = np.unique(np.concatenate(parts), return_counts=True)
        token, n = token[n > 1], n[n > 1]
        if len(n) > HOT_LOCAL:
            top = np.argpartition(-n, HOT_LOCAL)[:HOT_LOCAL]
            token, n = token[top], n[top]
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], ["token", "n"])

    counts = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(HOT_GLOBAL).select("token").toArrow()["token"].to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def signatures(docs: DataFrame, k: int, percent: int, hot: np.ndarray) -> DataFrame:
    """(doc_id, n, a, b, prefix): set size, 128-bit digest of the set, first tokens in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)  # at most HOT_GLOBAL longs

    def sign(batches):
        late = shared.value
        for batch in batches:
            n, a, b, prefixes = [], [], [], []
            for _, s in _sets(batch.column(1), k):
                n.append(len(s))
                m = mix(s)
                a.append(m.sum(dtype=np.uint64))
                b.append(mix(m ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                if len(s) and len(late):
                    at = np.minimum(np.searchsorted(late, s), len(late) - 1)
                    is_late = late[at] == s
                    s = np.concatenate([s[~is_late], s[is_late]])
                prefixes.append(s[: len(s) - (-(-percent * len(s) // 100)) + 1 if len(s) else 0])
            flat = np.concatenate([*prefixes, np.empty(0, np.uint64)])
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.array(n, np.int64)), pa.array(np.array(a, np.uint64).view(np.int64)),
                pa.array(np.array(b, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
                ["doc_id", "n", "a", "b", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(
        sign, "doc_id long, n long, a long, b long, prefix array<long>")


def shared_postings(sets: DataFrame) -> DataFrame:
    """(token, rep, n, pos, leader) of the postings in lists with two entries or more; the leader is the
    first entry of a list by (size, id). Lists are streamed: one entry is held back, never a list."""
    postings = sets.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    postings = postings.select("token", F.shiftleft("n", 32).bitwiseOR(F.col("pos").cast("long")).alias("at"), "rep")
    lists = postings.repartition("token").sortWithinPartitions("token", "at", "rep")

    names = ["token", "at", "rep", "leader", "leader_at"]

    def stream(batches):
        held, again = None, False  # the last row so far with its leader; whether its list has earlier rows
        for batch in batches:
            if batch.num_rows == 0:
                continue
            token, at, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                token, at, rep = (np.concatenate([[x], y]) for x, y in zip(held[:3], (token, at, rep), strict=True))
            first = np.ones(len(token), bool)
            first[1:] = token[1:] != token[:-1]
            start = np.maximum.accumulate(np.where(first, np.arange(len(token)), 0))
            leader, leader_at = rep[start], at[start]
            if held is not None:
                leader, leader_at = np.where(start == 0, held[3], leader), np.where(start == 0, held[4], leader_at)
            many = ~first
            many[:-1] |= token[1:] == token[:-1]
            many[0] |= again
            again, last = bool(not first[-1]) or (len(token) == 1 and again), len(token) - 1
            columns = (token, at, rep, leader, leader_at)
            held = tuple(x[last] for x in columns)
            out = np.flatnonzero(many[:last])
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in columns], names)
        if again:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], names)

    return lists.mapInArrow(stream, "token long, at long, rep long, leader long, leader_at long").select(
        "token", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos"), "rep", "leader",
        F.shiftright("leader_at", 32).alias("leader_n"))


def _needed(nx, ny, percent: int):
    """The smallest intersection that links: i * (100 + p) >= p * (nx + ny)."""
    return F.ceil((percent * (nx + ny)).cast("double") / (100 + percent))


def _prefix(n, percent: int):
    return n - F.ceil(percent * n / F.lit(100.0)) + 1


def with_centrality(lists: DataFrame) -> DataFrame:
    """``lists`` with ``score``: how long the lists of a set's postings are on average. In a cluster of near
    copies the text that they were made from has the highest."""
    sizes = lists.groupBy("token").agg(F.count("*").alias("size"))
    scores = lists.join(sizes, "token").groupBy("rep").agg(
        (F.sum(F.sqrt("size")) / F.max(_prefix(F.col("n"), PERCENT))).alias("score"))
    return lists.select("token", "n", "pos", "rep").join(scores, "rep")


def ties(lists: DataFrame, groups: DataFrame | None, checked: DataFrame | None, percent: int) -> DataFrame:
    """(rep, to, x, y): each set with the one set of another group that it shares most postings with, among the most
    central entry of each of its lists and the most central one outside that entry's group."""
    lists = _grouped(lists, groups)
    first = lists.groupBy("token").agg(F.max(F.struct("score", "rep", "grp", "n")).alias("a"), F.min("grp").alias("g0"), F.max("grp").alias("g1"))
    lists = lists.join(first.where("g0 <> g1").select("token", "a"), "token")
    if groups is not None:
        second = lists.where("grp <> a.grp").groupBy("token").agg(F.max(F.struct("score", "rep", "grp", "n")).alias("b"))
        lists = lists.join(second, "token").withColumn("a", F.when(F.col("grp") == F.col("a.grp"), F.col("b")).otherwise(F.col("a")))
    met = lists.where((F.col("grp") != F.col("a.grp")) & (100 * F.least("n", "a.n") >= percent * F.greatest("n", "a.n")))
    met = met.groupBy("rep", F.col("a.rep").alias("to")).agg(F.count("*").alias("o"), F.max("n").alias("n"))
    met = met.where(F.col("o") >= LIKELY * _prefix(F.col("n"), percent)).select(
        "rep", "to", F.least("rep", "to").alias("x"), F.greatest("rep", "to").alias("y"), "o")
    if checked is not None:
        met = met.join(checked.select("x", "y"), ["x", "y"], "left_anti")
    best = met.groupBy("rep").agg(F.max_by("to", F.struct("o", -F.col("to"))).alias("to"))
    return best.select("rep", "to", F.least("rep", "to").alias("x"), F.greatest("rep", "to").alias("y"))


def _grouped(lists: DataFrame, groups: DataFrame | None) -> DataFrame:
    if groups is None:
        return lists.withColumn("grp", F.col("rep"))
    return lists.join(groups, "rep", "left").withColumn("grp", F.coalesce("grp", "rep"))


def stars(tied: DataFrame, repeated: DataFrame) -> DataFrame:
    """(rep, centre): the sets that several others were tied to, and what was tied to them; without ids
    that stand for several texts."""
    tied = tied.join(repeated.withColumnRenamed("doc_id", "rep"), "rep", "left_anti")
    centres = tied.groupBy("to").count().where("count > 1").select(F.col("to").alias("centre"))
    centres = keep(centres.join(repeated.withColumnRenamed("doc_id", "centre"), "centre", "left_anti"), "centres")
    leaves = tied.join(centres, F.col("to") == F.col("centre")).select("rep", "centre")
    leaves = leaves.join(centres.select(F.col("centre").alias("rep")), "rep", "left_anti")
    return keep(leaves.unionByName(centres.select(F.col("centre").alias("rep"), "centre")), "stars")


def star_pairs(sets: DataFrame, star: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(x, y, o): pairs of sets of one star but different groups that can link, by the o tokens of their
    prefixes in which both differ from the centre."""
    star = _grouped(star, groups)
    several = star.groupBy("centre").agg(F.min("grp").alias("g0"), F.max("grp").alias("g1")).where("g0 <> g1").select("centre")
    open_ = star.join(several, "centre").where("rep <> centre")
    both = open_.join(_named(sets, open_.select(F.col("rep").alias("id"))).toDF("rep", "sx"), "rep").join(
        _named(sets, open_.select(F.col("centre").alias("id"))).toDF("centre", "sy"), "centre").select("centre", "rep", "grp", "sx", "sy")

    def differences(batches):
        for batch in batches:
            missing, tokens, size = [], [], []
            for i in range(batch.num_rows):
                x, c = (np.asarray(batch.column(k)[i].values) for k in (3, 4))
                less = np.setdiff1d(c, x, assume_unique=True)
                missing.append(len(less))
                size.append(len(c))
                tokens.append(np.concatenate([less, np.setdiff1d(x, c, assume_unique=True)]))
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(size, pa.int64()), pa.array(missing, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*tokens, np.empty(0, np.int64)])))],
                ["centre", "rep", "grp", "nc", "missing", "tokens"])

    apart = keep(both.mapInArrow(differences, "centre long, rep long, grp long, nc long, missing long, tokens array<long>"), "apart")
    d = F.size("tokens").cast("long")
    g = 100 * F.col("missing") + percent * (d - F.col("missing"))
    spare = (100 - percent) * F.col("nc")
    # a set not linked to the centre shares more than g / (100 + percent) with any set not linked to it, and
    # at least (g - spare) / (100 + percent) with one that is; the latter shares more than its own g / (100 + percent)
    short = d - F.floor(g / (100 + percent)).cast("long")
    long_ = d - F.ceil((g - spare) / (100 + percent)).cast("long") + 1
    entries = apart.select("centre", "rep", "grp", (g > spare).alias("far"), short.alias("short"), long_.alias("long"),
                           d.alias("d"), F.explode("tokens").alias("token"))
    common = entries.groupBy("centre", "token").agg(F.count("*").alias("size")).where("size > 1")
    entries = entries.join(common, ["centre", "token"])
    # tokens that no other set of the star differs in come first in the order and meet nobody
    own = Window.partitionBy("centre", "rep")
    at = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("size", "token"))
    entries = entries.withColumn("at", at).where("at <= short or (far and at <= long)")
    entries = keep(entries.select("centre", "token", "rep", "grp", "far", (F.col("at") <= F.col("short")).alias("near_prefix")), "entries")
    x = entries.where("far").select("centre", "token", F.col("rep").alias("x"), F.col("grp").alias("gx"), F.col("near_prefix").alias("px"))
    y = entries.where("near_prefix").select("centre", "token", F.col("rep").alias("y"), F.col("grp").alias("gy"), F.col("far").alias("fy"))
    met = x.join(y, ["centre", "token"]).where("gx <> gy and (not fy or (px and x < y))")
    return met.groupBy("x", "y").agg(F.count("*").alias("o"))


def cross_pairs(lists: DataFrame, groups: DataFrame, star: DataFrame, percent: int) -> DataFrame:
    """(x, y, o): pairs of different groups and different stars that share o postings and can still reach
    the threshold. ``groups``: (rep, grp) of the sets that are not alone."""
    lists, key = _grouped(lists, groups), ["token"]
    lists = lists.join(star, "rep", "left").withColumn("centre", F.coalesce("centre", -1 - F.col("rep")))
    mixed = lists.groupBy(*key).agg(F.min("grp").alias("g0"), F.max("grp").alias("g1"), F.min("centre").alias("c0"), F.max("centre").alias("c1"))
    lists = lists.join(mixed.where("g0 <> g1 and c0 <> c1").select(*key), key, "left_semi")
    x = lists.select(*key, *(F.col(c).alias(f"x_{c}") for c in ("rep", "n", "pos", "grp", "centre")))
    y = lists.select(*key, *(F.col(c).alias(f"y_{c}") for c in ("rep", "n", "pos", "grp", "centre")))
    nx, ny = F.col("x_n"), F.col("y_n")
    both = x.join(y, key).where("x_grp <> y_grp and x_centre <> y_centre and (x_n < y_n or (x_n = y_n and x_rep < y_rep))").where(
        (100 * nx >= percent * ny)
        & (1 + F.least(F.col("x_pos"), F.col("y_pos")) + F.least(nx - F.col("x_pos"), ny - F.col("y_pos")) - 1
           >= _needed(nx, ny, percent)))
    pairs = both.groupBy(F.col("x_rep").alias("x"), F.col("y_rep").alias("y")).agg(
        F.count("*").alias("o"), F.max(nx).alias("nx"), F.max(ny).alias("ny"))
    nx, ny = F.col("nx"), F.col("ny")
    rest = F.greatest(nx - _prefix(nx, percent), ny - _prefix(ny, percent))
    return pairs.where(F.col("o") + rest >= _needed(nx, ny, percent)).select("x", "y", "o")


def whole_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, s): the whole sets of the texts of ``ids`` and of a few others that the bitmap lets through."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(BITMAP_BITS)).alias("at")
    bits = bitmap(ids.select(F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS)).alias("at")))

    def build(batches):
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(bits.value, batch.column(2).to_numpy(zero_copy_only=False))))
            if batch.num_rows:
                found = [s for _, s in _sets(batch.column(1), k)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                values = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "s"])

    return docs.select("doc_id", "text", place).mapInArrow(build, "id long, s array<long>")


def _named(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The ``sets`` of ``ids`` and of a few others that a bitmap of fixed size lets through."""
    at = F.pmod(F.xxhash64("id"), F.lit(PLACES))
    words = ids.select(at.alias("at")).groupBy(F.expr("at div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits"))  # at most PLACES / 64 rows
    placed = sets.withColumn("at", at).withColumn("word", F.expr("at div 64"))
    return placed.join(F.broadcast(words), "word").where("getbit(bits, int(at % 64)) = 1").select("id", "s")


def verify(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(x, y, linked, near) of ``pairs`` by their whole ``sets`` (id, s), which travel once for each side of a pair."""

    def compare(batches):
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            shared, union = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                a, b = (np.asarray(c[i].values) for c in (xs, ys))
                shared[i] = len(np.intersect1d(a, b, assume_unique=True))
                union[i] = len(a) + len(b) - shared[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(100 * shared >= percent * union), pa.array(100 * shared >= NEAR * union)],
                ["x", "y", "linked", "near"])

    left = pairs.join(_named(sets, pairs.select(F.col("x").alias("id"))).toDF("x", "sx"), "x")
    full = left.join(_named(sets, pairs.select(F.col("y").alias("id"))).toDF("y", "sy"), "y").select("x", "y", "sx", "sy")
    return full.mapInArrow(compare, "x long, y long, linked boolean, near boolean").distinct()


def _best(pairs: DataFrame) -> DataFrame:
    """(x, y): for each set the pair in which it shares most postings."""
    both = pairs.select("x", "y", "o").union(pairs.select("y", "x", "o"))
    best = both.groupBy("x").agg(F.max_by("y", F.struct("o", -F.col("y"))).alias("y"))
    return best.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _apart(pairs: DataFrame, parts: DataFrame, checked: DataFrame) -> DataFrame:
    """``pairs`` that were not checked and are not of one component of the links found so far."""
    px = parts.select(F.col("rep").alias("x"), F.col("grp").alias("gx"))
    py = parts.select(F.col("rep").alias("y"), F.col("grp").alias("gy"))
    pairs = pairs.join(px, "x", "left").join(py, "y", "left").where(
        F.coalesce("gx", "x") != F.coalesce("gy", "y")).drop("gx", "gy")
    return pairs.join(checked, ["x", "y"], "left_anti")


def _parts(links: DataFrame) -> DataFrame:
    return keep(components(links.select(F.col("x").alias("u"), F.col("y").alias("v"))).select(
        F.col("id").alias("rep"), F.col("component").alias("grp")), "parts")


def _linked(lists: DataFrame, sets: DataFrame, repeated: DataFrame, percent: int) -> DataFrame:
    """(rep, grp): the component of every set that has a link."""
    checked, parts, star = None, None, None
    for _ in range(ROUNDS):
        tied = keep(ties(lists, parts, checked, percent), "ties")
        if tied.isEmpty():
            break
        found = keep(verify(sets, tied.select("x", "y").distinct(), percent), "checked")
        if star is None:
            star = stars(tied.join(found.where("near").select("x", "y").distinct(), ["x", "y"]), repeated)
        checked = found if checked is None else checked.union(found)
        if found.where("linked").isEmpty():
            break
        parts = _parts(checked.where("linked"))
    if checked is None:
        spark = sets.sparkSession
        checked = spark.createDataFrame([], "x long, y long, linked boolean, near boolean")
        star = spark.createDataFrame([], "rep long, centre long")
    if parts is None:
        parts = _parts(checked.where("linked"))
    pairs = cross_pairs(lists, parts, star, percent).unionByName(star_pairs(sets, star, parts, percent)).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "o")
    for chosen in (_best, lambda rest: rest.select("x", "y")):
        pairs = keep(_apart(pairs, parts, checked.select("x", "y")), "pairs")
        if pairs.isEmpty():
            break
        checked = checked.union(keep(verify(sets, chosen(pairs), percent), "checked"))
        parts = _parts(checked.where("linked"))
    return parts


def jaccard_components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text); see the module's text."""
    docs = docs.select("doc_id", "text")
    texts = docs.where(F.col("text").isNotNull())
    signed = keep(signatures(docs, k, percent, frequent_tokens(docs, k)), "signatures")
    classes = keep(signed.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep")), "classes")
    one = signed.where("n > 0").join(classes.select(F.col("rep").alias("doc_id"), "a", "b"), ["doc_id", "a", "b"], "left_semi")
    lists = keep(shared_postings(one.select(F.col("doc_id").alias("rep"), "n", "prefix")), "lists")
    lists = keep(with_centrality(lists), "central")
    sets = keep(whole_sets(texts, lists.select(F.col("rep").alias("id")).distinct(), k), "sets")
    repeated = keep(signed.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    parts = _linked(lists, sets, repeated, percent)
    classes = classes.join(parts, "rep", "left").select("a", "b", F.coalesce("grp", "rep").alias("component"))
    return signed.join(classes, ["a", "b"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one_of_each_group(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their component; rows without words all stay. Of repeated
    rows with one doc_id, one stays."""
    groups = jaccard_components(docs, k, percent)
    gone = groups.where("n_shingles > 0 and doc_id <> component_id").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti")
    again = rest.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return rest
    order = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in docs.columns])
    twice = rest.join(again, "doc_id", "left_semi").withColumn("_row", F.row_number().over(order))
    return rest.join(again, "doc_id", "left_anti").unionByName(twice.where("_row = 1").drop("_row"))
