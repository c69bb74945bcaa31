"""Item feature table: counts per medium, shares, dominant medium, name-keyed score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import MEDIA, dominant, share
from ..functions.text import try_number
from .clean import keep_first
from .skew import HOT_ROWS, salted_lookup


def count_by_key(df: DataFrame, key: str, count: str = "n") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count))


def occurrences(tables: dict[str, DataFrame], key: str = "item_id") -> DataFrame:
    """The event tables side by side as (item_id, medium)."""
    out = None
    for medium, df in tables.items():
        part = df.select(F.col(key).cast("string").alias("item_id"), F.lit(medium).alias("medium"))
        out = part if out is None else out.unionByName(part)
    return out


def medium_counts(occ: DataFrame) -> DataFrame:
    """One aggregation for all media: item_id, n_film, n_tv, n_lit."""
    counts = [F.count_if(F.col("medium") == m).alias(f"n_{m}") for m in MEDIA]
    return occ.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(*counts)


def feature_counts(items: DataFrame, occ: DataFrame) -> DataFrame:
    joined = items.join(medium_counts(occ), "item_id", "left")
    for m in MEDIA:
        joined = joined.withColumn(f"n_{m}", F.coalesce(F.col(f"n_{m}"), F.lit(0)).cast("long"))
    return joined.withColumn("n_total", sum((F.col(f"n_{m}") for m in MEDIA), F.lit(0).cast("long")))


def media_mix(df: DataFrame) -> DataFrame:
    for m in MEDIA:
        df = df.withColumn(f"frac_{m}", share(F.col(f"n_{m}"), F.col("n_total")))
    return df


def dominant_medium(df: DataFrame, column: str = "dominant_media") -> DataFrame:
    return df.withColumn(column, dominant([(m, F.col(f"n_{m}")) for m in MEDIA]))


def first_scores(scores: DataFrame) -> DataFrame:
    """(name, score text, ord) -> the first usable number of each name."""
    parsed = scores.select("name", try_number(F.col("score")).alias("score"), "ord")
    return keep_first(parsed.where(F.col("score").isNotNull()), ["name"], "ord").drop("ord")


def name_score_lookup(items: DataFrame, scores: DataFrame, column: str = "gender_ratio",
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    lookup = first_scores(scores).withColumnRenamed("score", column)
    return salted_lookup(items, lookup, "name", "left", hot_rows)


def category_counts(df: DataFrame, column: str = "dominant_media") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def feature_metrics(features: DataFrame, score: str = "gender_ratio") -> DataFrame:
    return features.agg(F.count("*").alias("items"),
                        *[F.sum(f"n_{m}").alias(f"{m}_rows") for m in MEDIA],
                        F.count(score).alias("scored"))
