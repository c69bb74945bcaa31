"""Aligning tables by item id: features to vectors, work lists, surviving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_unique(df: DataFrame, key: str) -> None:
    twice = df.groupBy(key).count().where(F.col("count") > 1).take(1)
    if twice:
        raise ValueError(f"{key} {twice[0][key]!r} occurs {twice[0]['count']} times")


def align_features(vectors: DataFrame, features: DataFrame, key: str = "item_id",
                   check: bool = True) -> DataFrame:
    """Feature columns for every vector row; rows without features get nulls."""
    if check:
        require_unique(features, key)
    return vectors.join(features, key, "left")


def pending(texts: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Input rows that have no stored result yet."""
    return texts.join(done.select(key), key, "left_anti")


def with_vectors(texts: DataFrame, vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """Input rows that have a vector; vectors of ids no longer in the input drop out."""
    return texts.join(vectors, key, "inner")
