"""Final point rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_even
from ..functions.text import short_text
from .clean import optional_column


def assemble_points(df: DataFrame) -> DataFrame:
    """One projection to the published shape: coordinates at 4 decimals, scores at 3, missing
    counts as 0. Input: i, item_id, x, y, x3, y3, z3, cluster, group_idx, anchor, top3, sa01, nn
    and the optional feature columns."""
    def count(name: str) -> Column:
        return F.coalesce(optional_column(df, name, 0).cast("long"), F.lit(0))

    coordinates = [half_even(F.col(c), 4).alias(c) for c in ("x", "y", "x3", "y3", "z3")]
    return df.select(
        "i", F.col("item_id").cast("string").alias("id"), optional_column(df, "name").alias("name"),
        *coordinates, F.col("cluster").alias("c"), F.col("group_idx").alias("sg"),
        F.col("anchor").alias("gen"), F.col("top3").alias("g3"),
        F.transform("sa01", lambda s: half_even(s, 3)).alias("sa"),
        optional_column(df, "dominant_media", "unknown").alias("media"),
        count("n_film").alias("nf"), count("n_tv").alias("nt"), count("n_lit").alias("nl"),
        count("n_total").alias("tot"),
        half_even(optional_column(df, "gender_ratio").cast("double"), 3).alias("g"),
        short_text(optional_column(df, "description", "").cast("string")).alias("d"), "nn")


def points_meta(n: int, model: str, layout: str, clusters: int, groups: DataFrame,
                anchors: DataFrame) -> DataFrame:
    """The one-row description that goes with the points; groups and anchors are small legends."""
    legend = groups.agg(F.sort_array(F.collect_list(F.struct("group_idx", "key", "label", "color"))).alias("g"))
    names = anchors.agg(F.sort_array(F.collect_list(F.struct("anchor_idx", "name"))).alias("a"))
    one = groups.sparkSession.range(1)
    return (one.withColumn("_g", legend.scalar()).withColumn("_a", names.scalar())
            .select(F.lit(n).alias("n"), F.lit(model).alias("model"), F.lit(layout).alias("layout"),
                    F.lit(clusters).alias("clusters"),
                    F.transform("_g", lambda g: F.struct(g["key"].alias("key"), g["label"].alias("label"),
                                                         g["color"].alias("color"))).alias("groups"),
                    F.transform("_a", lambda a: a["name"]).alias("anchors")))
