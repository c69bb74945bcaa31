"""Mixing sources to target weights by Pareto order sampling (operator 5).

Sources, ordered by code point with null last, have weights 3, 1, 2, repeating. They share 150 % of all
words by weight; no target exceeds twice its source's words, and what is cut off is shared again by
weight among the rest. A source with ratio r = target / words takes floor(r) certain copies of every
document. The fraction that is left is sampled with unequal probabilities: a document of b binary digits of
size has inclusion probability pi = min(1, c b), with the c of its source for which the expected words are
the rest of the target. Documents are ranked by their random odds over their inclusion odds,
u / (1 - u) * (1 - pi) / pi, and taken in this order until their words meet the rest (the last one if at
least half of it fits): a sample of fixed size, in words. u comes from the MD5 of seed and doc_id, so reruns
agree.

Sizes are summed by source and digits (at most 64 rows a source), which gives c exactly. The cut needs no
sorted source: words are summed by source and by 4096 ranges of the rank, and only the one range per source in
which the cut falls is ordered. Rows per source are joined back.

Null and empty texts have size 0 and are never taken; a very long text is counted whole. Repeated rows are
documents of their own that rank together; ties of rank go by size and doc_id. A null source is a source; a
null doc_id ranks as the empty string. An empty table gives no rows. Columns of the input are carried in one
struct, so that no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.small import small_broadcast
from .common import keep

SEED = "mix-1"
RANGES = 4096

WORDS = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sized(docs: DataFrame, carry: list[str], seed: str = SEED) -> DataFrame:
    """(row, source, size, digits, id, u): ``row`` holds the columns of ``carry``."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    u = (u.cast("long").cast("double") + 0.5) / float(1 << 52)
    rows = docs.select(F.struct(*carry).alias("row"), F.col("source").alias("source"), words(F.col("text")).alias("size"),
                       F.col("doc_id").alias("id"), u.alias("u"))
    return rows.withColumn("digits", F.length(F.bin("size")))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.row_number().over(order) - 1) % 3 + 1).cast("long")
    s = sizes.select("source", "source_size", F.sum("source_size").over(Window.partitionBy()).alias("whole"), weight.alias("w"))
    fill = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("done"),
                 F.sum("w").over(Window.partitionBy()).alias("ws"), F.coalesce(F.sum("w").over(before), F.lit(0)).alias("wd"))
    # full: its share of what those before it leave is above twice its words (all sums doubled to stay integers)
    full = (3 * F.col("whole") - 4 * F.col("done")) * F.col("w") > 4 * F.col("source_size") * (F.col("ws") - F.col("wd"))
    s = s.withColumn("full", full)
    everything = Window.partitionBy()
    s = s.select("*", F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(everything), F.lit(0)).alias("cut"),
                 F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(everything), F.lit(0)).alias("open"))
    share = (F.col("w") * (3 * F.col("whole") - 4 * F.col("cut"))).cast("double") / (2 * F.col("open")).cast("double")
    return s.select("source", "source_size",
                    F.when(F.col("full"), (2 * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def inclusion(rows: DataFrame) -> DataFrame:
    """(t, digits, source_size, target, whole, rest, pi), one row per source t and number of digits."""
    classes = rows.groupBy("source", "digits").agg(F.sum("size").alias("words"))
    per_source = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    per_source = per_source.withColumn("whole", F.floor(ratio)).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "t")
    each = classes.join(per_source, F.col("source").eqNullSafe(F.col("t")))
    larger = Window.partitionBy("source").orderBy(F.desc("digits")).rowsBetween(Window.unboundedPreceding, -1)
    others = Window.partitionBy("source").orderBy(F.desc("digits")).rowsBetween(0, Window.unboundedFollowing)
    weighted = F.col("digits") * F.col("words")
    each = each.withColumn("above", F.coalesce(F.sum("words").over(larger), F.lit(0))).withColumn(
        "below", F.sum(weighted).over(others))
    # certain: with all larger ones certain, c times its digits would exceed 1
    each = each.withColumn("certain", (F.col("rest") - F.col("above")) * F.col("digits") > F.col("below"))
    alone = Window.partitionBy("source")
    left = F.col("rest") - F.coalesce(F.sum(F.when(F.col("certain"), F.col("words"))).over(alone), F.lit(0))
    share = F.coalesce(F.sum(F.when(~F.col("certain"), weighted)).over(alone), F.lit(0))
    c = F.when(share > 0, left / F.when(share > 0, share)).otherwise(F.lit(0.0))
    pi = F.when(F.col("certain"), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c * F.col("digits"))))
    return each.withColumn("pi", pi).select("t", F.col("digits").alias("d"), "source_size", "target", "whole", "rest", "pi")


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with source_size, target, whole, rest, rank and bucket."""
    # at most 64 rows a source: broadcast while they are few, so that a source with a third of all rows stays spread
    per = small_broadcast(keep(inclusion(rows), "inclusion"))
    joined = rows.join(per, F.col("source").eqNullSafe(F.col("t")) & (F.col("digits") == F.col("d"))).drop("t", "d")
    odds = F.col("u") / (1 - F.col("u"))
    # beyond every rank where nothing is to be taken
    rank = F.when(F.col("pi") > 0, odds * ((1 - F.col("pi")) / F.when(F.col("pi") > 0, F.col("pi")))).otherwise(odds + 1e18)
    return joined.withColumn("rank", rank).withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * RANGES))


def allocate(rows: DataFrame) -> DataFrame:
    """``rows`` of ``sized`` with source_size, target and copies (0, 1 or 2)."""
    rows = ranked(rows)
    ranges = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.any_value("rest").alias("rest"))
    run = Window.partitionBy("source").orderBy("bucket")
    # the range in which the cut falls: the first that ends beyond the rest
    ends = ranges.withColumn("end", F.sum("words").over(run)).groupBy(F.col("source").alias("t")).agg(F.min(F.when(
        F.col("end") > F.col("rest"), F.struct("bucket", (F.col("end") - F.col("words")).alias("base")))).alias("c"))
    ends = ends.select("t", F.coalesce("c.bucket", F.lit(RANGES + 1)).alias("at"), F.coalesce("c.base", F.lit(0)).alias("base"))
    joined = rows.join(small_broadcast(keep(ends, "cuts")), F.col("source").eqNullSafe(F.col("t"))).drop("t")
    sure = joined.where("bucket <> at").withColumn("more", (F.col("bucket") < F.col("at")).cast("int"))
    order = Window.partitionBy("source").orderBy("rank", "size", "id").rowsBetween(Window.unboundedPreceding, 0)
    edge = joined.where("bucket = at").withColumn("until", F.col("base") + F.sum("size").over(order))
    edge = edge.withColumn("more", (F.col("until") - F.col("size") / 2 <= F.col("rest")).cast("int")).drop("until")
    return sure.unionByName(edge).select("row", "size", "source_size", "target", "pi", F.when(
        F.col("size") > 0, F.col("whole") + F.col("more")).otherwise(0).cast("int").alias("copies"))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it."""
    rows = allocate(sized(docs, docs.columns, seed))
    taken = rows.where("size > 0 and copies > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return taken.select("row.*")
