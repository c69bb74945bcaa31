"""Look-up joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .small import MAX_BROADCAST_ROWS

HOT_KEYS = 4096
HOT_ROWS = 1_000_000
NULL_SALTS = 1 << 16  # rows without a key match nothing; they are spread over all tasks


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> list[tuple]:
    """(key, number of salts) of the at most 4096 most frequent keys above ``hot_rows`` rows.

    Any key left out holds at most 1/4096 of the rows. Counting is combined before its shuffle and
    reads the key column only.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).count()
    top = counts.where(F.col("count") > hot_rows).orderBy(F.desc("count")).limit(HOT_KEYS)
    return [(row[key], -(-row["count"] // hot_rows)) for row in top.collect()]


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, how: str = "left",
                  hot_rows: int = HOT_ROWS, hot: list[tuple] | None = None) -> DataFrame:
    """Join ``rows`` to ``lookup`` (unique on ``key``), splitting hot keys into salts.

    Only the look-up rows of hot keys are repeated, once per salt. Rows with a null key are spread by
    a hash of the row. ``hot``: the result of ``hot_keys`` when it is known already.
    """
    hot = hot_keys(rows, key, hot_rows) if hot is None else hot
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(NULL_SALTS))
    if not hot:
        if how != "left":
            return rows.join(lookup, key, how)
        left = rows.withColumn("_salt", F.when(F.col(key).isNull(), spread).otherwise(F.lit(0).cast("long")))
        right = lookup.withColumn("_salt", F.lit(0).cast("long"))
        return left.join(right, [key, "_salt"], how).drop("_salt")
    salts = F.broadcast(rows.sparkSession.createDataFrame(  # at most 4096 rows
        hot, T.StructType([rows.schema[key], T.StructField("_salts", T.LongType())])))
    salt = F.when(F.col(key).isNull(), spread).otherwise(
        F.pmod(F.xxhash64(*rows.columns), F.coalesce(F.col("_salts"), F.lit(1))))
    left = rows.join(salts, key, "left").withColumn("_salt", salt).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    right = lookup.join(salts, key, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def legend_lookup(rows: DataFrame, legend: DataFrame, key: str) -> DataFrame:
    """Left look-up in a legend (unique on ``key``) that is usually a few rows: broadcast while it
    is small, otherwise a salted join, as a popular entry may hold much of the rows."""
    if legend.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        return rows.join(F.broadcast(legend), key, "left")
    return salted_lookup(rows, legend, key)
