"""Vectors + anchors + features -> points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import affinity as A
from ..operators.align import align_features
from ..operators.clean import dense_index
from ..operators.cluster import kmeans_clusters
from ..operators.nearest import knn_graph
from ..operators.points import assemble_points, points_meta
from ..operators.reduce import layout
from ..sources.storage import materialize


@dataclass
class Projection:
    points: DataFrame
    meta: DataFrame


def affinity_profile(z: DataFrame, anchors: DataFrame, groups: DataFrame) -> DataFrame:
    """Row-local roll-up of the standardised affinities: (item_id, anchor, top3, group_idx, sa01).

    Anchor names are a legend of a few hundred entries, carried as one array.
    """
    sa = A.group_affinity(z, A.group_membership(anchors, groups), groups)
    sa = materialize(sa, "groups")
    names = A.with_table(z, anchors, "anchor_idx", "name")

    def name_of(idx):
        return F.element_at("_table", idx + 1)["name"]

    best = names.select(
        "item_id", name_of(A.best_index(F.col("z"))).alias("anchor"),
        F.transform(A.top_indices(F.col("z"), 3), lambda s: F.element_at("_table", s["idx"] + 1)["name"])
        .alias("top3"))
    return (best.join(sa.select("item_id", A.best_index(F.col("sa")).alias("group_idx")), "item_id")
            .join(A.group_minmax(sa), "item_id"))


def project(vectors: DataFrame, features: DataFrame, anchors: DataFrame, groups: DataFrame,
            neighbors: int = 10, clusters: int = 24, model: str = "unknown") -> Projection:
    """``vectors``: (item_id, v); ``features``: keyed by item_id; ``anchors``: (anchor_idx, name,
    group_key, v); ``groups``: (group_idx, group_key, key, label, color).

    The standardised affinities are written once and feed ranking, layout and clusters; the
    neighbour graph uses the full vectors. Where both sides name their model and dimension, these
    must be the same.
    """
    if {"model", "dim"} <= set(vectors.columns) & set(anchors.columns):
        A.check_same_space(vectors, anchors)
    items = materialize(dense_index(vectors.select("item_id", "v"), ["item_id"], "i"), "items")
    z = materialize(A.anchor_zscore(materialize(A.affinity(items, anchors), "affinity")), "z")
    n = items.count()
    edges = knn_graph(items.select(F.col("i").alias("idx"), "v"), neighbors)
    nn = edges.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("e"))
    nn = nn.select(F.col("src").alias("i"), F.transform("e", lambda e: e["dst"]).alias("nn"))
    points = (align_features(items.select("i", "item_id"), features)
              .join(affinity_profile(z, anchors, groups), "item_id")
              .join(layout(z), "item_id")
              .join(kmeans_clusters(z, clusters, vec="z"), "item_id")
              .join(nn, "i", "left"))
    meta = points_meta(n, model, "pca-affinity", min(clusters, n), groups, anchors)
    return Projection(assemble_points(points), meta)
