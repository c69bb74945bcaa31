"""k-means clusters and assignment to given centroids."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .affinity import affinity, best_index


def fit_kmeans(items: DataFrame, k: int = 24, restarts: int = 4, seed: int = 42,
               vec: str = "v") -> tuple[KMeansModel, int]:
    """Best of ``restarts`` runs by inertia, with k at most the number of items."""
    vectors = items.select(array_to_vector(F.col(vec).cast("array<double>")).alias("f")).persist()
    try:
        k = min(k, vectors.count())
        if k < 2:
            return None, k  # one item, one cluster
        runs = (KMeans(k=k, seed=seed + i, featuresCol="f", predictionCol="cluster").fit(vectors)
                for i in range(restarts))
        return min(runs, key=lambda m: m.summary.trainingCost), k
    finally:
        vectors.unpersist()


def kmeans_clusters(items: DataFrame, k: int = 24, restarts: int = 4, seed: int = 42,
                    key: str = "item_id", vec: str = "v") -> DataFrame:
    """(key, cluster)."""
    model, _ = fit_kmeans(items, k, restarts, seed, vec)
    if model is None:
        return items.select(key, F.lit(0).alias("cluster"))
    vectors = items.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("f"))
    return model.transform(vectors).select(key, "cluster")


def assign_centroids(items: DataFrame, centroids: DataFrame, key: str = "item_id", **limits) -> DataFrame:
    """Nearest centroid by Euclidean distance, lowest index on ties: (key, cluster, dist2).

    ``centroids``: (anchor_idx dense from 0, v).
    """
    far = affinity(items, centroids, key, kernel="squared_distance", **limits)
    nearest = far.withColumn("cluster", best_index(F.transform("a", lambda d: -d)))
    return nearest.select(key, "cluster", F.element_at("a", F.col("cluster") + 1).alias("dist2"))
