"""Vectors -> reduced and quantised universe -> recipes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators.compose import Closure, craft_universe, reach_closure, vectors_fingerprint
from ..operators.reduce import Reduction, apply_pca, fit_pca
from ..sources.storage import materialize


def global_scale(*frames: DataFrame, vec: str = "v") -> DataFrame:
    """One row: the largest absolute component over all vectors."""
    stacked = frames[0].select(vec)
    for df in frames[1:]:
        stacked = stacked.unionByName(df.select(vec))
    return stacked.agg(F.max(V.abs_max(F.col(vec))).alias("scale"))


def round_trip(df: DataFrame, scale: float, vec: str = "v") -> DataFrame:
    """Quantise to 8 bits and back, so that the closure runs on the vectors a reader will see."""
    s = F.lit(float(scale))
    coded = df.withColumn("q", V.quantize(F.col(vec), s))
    return coded.withColumn(vec, V.dequantize(F.col("q"), s))


def stored_closure(universe: DataFrame, seeds: DataFrame, folder: str | None = None) -> Closure:
    """The closure of these very vectors from ``folder`` if it was finished before, else computed
    and stored there. The key is a hash of the contents, so a new embedding is never mistaken for
    an old one."""
    if folder is None:
        return reach_closure(universe, seeds)
    spark = universe.sparkSession
    key = (f"{vectors_fingerprint(universe.select('item_idx', 'v'))}-"
           f"{vectors_fingerprint(seeds.select(F.col('seed_idx').alias('item_idx'), 'v'))}")
    path = f"{folder}/{key}"
    try:
        meta = spark.read.parquet(f"{path}/meta").first()  # written last
        return Closure(spark.read.parquet(f"{path}/recipes"), *meta)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
    done = reach_closure(universe, seeds)
    done.recipes.write.mode("overwrite").parquet(f"{path}/recipes")
    spark.createDataFrame([(done.total, done.reached, done.rounds, done.hubs)],
                          "total long, reached long, rounds long, hubs long").write.parquet(f"{path}/meta")
    return Closure(spark.read.parquet(f"{path}/recipes"), done.total, done.reached, done.rounds, done.hubs)


@dataclass
class Craft:
    universe: DataFrame  # item_idx, kind, name, q, v
    seeds: DataFrame  # seed_idx, name, q, v
    scale: float
    reduction: Reduction
    closure: Closure


def build(words: DataFrame, anchors: DataFrame, items: DataFrame, seeds: DataFrame, dim: int = 48,
          require_complete: bool = True, closures: str | None = None) -> Craft:
    """``words``, ``anchors``, ``items``: (ord, name, v) each; ``seeds``: (seed_idx, name, v). The
    axes are fitted on the items only and applied to everything. ``require_complete``: an error
    unless every item is reached. ``closures``: a folder of finished
    closures to reuse."""
    fitted = fit_pca(items, dim)
    whole = craft_universe(("word", words), ("genre", anchors), ("item", items))
    whole = materialize(whole.select("item_idx", "kind", "name", "v"), "universe")
    reduced = materialize(whole.drop("v").join(apply_pca(whole, fitted, "item_idx"), "item_idx"), "reduced")
    seeds_reduced = materialize(seeds.drop("v").join(apply_pca(seeds, fitted, "seed_idx"), "seed_idx"), "seeds")
    scale = global_scale(reduced, seeds_reduced).first()["scale"]
    universe = materialize(round_trip(reduced, scale), "universe")
    start = materialize(round_trip(seeds_reduced, scale), "seeds")
    closure = stored_closure(universe, start, closures)
    if require_complete:
        closure.require_complete()
    return Craft(universe, start, scale, fitted, closure)
