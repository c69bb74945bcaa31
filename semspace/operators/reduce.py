"""Principal components, layout coordinates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import arrow_type, matrix, unit_rows, vector_column


@dataclass
class Reduction:
    mean: np.ndarray  # (dim,)
    axes: np.ndarray  # (dim, k), largest loading of each axis positive
    ratio: np.ndarray  # share of the variance held by each axis


def fit_pca(items: DataFrame, k: int, vec: str = "v") -> Reduction:
    """Principal axes of the centred vectors. Only (dim x dim) and smaller reach the driver."""
    vectors = items.select(array_to_vector(F.col(vec).cast("array<double>")).alias("f"))
    model = PCA(k=k, inputCol="f", outputCol="p").fit(vectors)
    mean = vectors.select(Summarizer.mean(F.col("f")).alias("m")).first()["m"].toArray()
    axes = model.pc.toArray()
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Reduction(mean, axes * np.where(signs == 0, 1, signs), model.explainedVariance.toArray())


def apply_pca(df: DataFrame, fitted: Reduction, key: str, unit: bool = True) -> DataFrame:
    """Project on the axes after subtracting the fitted mean: (key, v array<double>)."""
    held = df.sparkSession.sparkContext.broadcast((fitted.mean, fitted.axes))
    key_type = arrow_type(df, key)

    def run(incoming):
        mean, axes = held.value
        for batch in incoming:
            if batch.num_rows:
                m = (matrix(batch.column("v")) - mean) @ axes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(key).cast(key_type), vector_column(unit_rows(m) if unit else m)],
                    names=[key, "v"])

    schema = T.StructType([df.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))])
    return df.select(key, "v").mapInArrow(run, schema)


def norm_coords(df: DataFrame, axes: list[str]) -> DataFrame:
    """Centre each axis and divide all of them by the one largest absolute value (1 if 0)."""
    stats = [f(c).alias(f"{n}_{c}") for c in axes for n, f in
             (("avg", F.avg), ("min", F.min), ("max", F.max))]
    wide = F.greatest(F.lit(0.0), *[F.greatest(F.col(f"max_{c}") - F.col(f"avg_{c}"),
                                               F.col(f"avg_{c}") - F.col(f"min_{c}")) for c in axes])
    one = df.agg(*stats).select(F.struct(*[F.col(f"avg_{c}").alias(c) for c in axes],
                                         F.when(wide > 0, wide).otherwise(1.0).alias("scale")))
    df = df.withColumn("_s", one.scalar())
    for c in axes:
        df = df.withColumn(c, (F.col(c) - F.col(f"_s.{c}")) / F.col("_s.scale"))
    return df.drop("_s")


def layout(z: DataFrame, key: str = "item_id", vec: str = "z") -> DataFrame:
    """2D (x, y) and 3D (x3, y3, z3) positions from the leading axes of the affinity space."""
    vectors = z.select(key, F.col(vec).alias("v"))
    flat = apply_pca(vectors, fit_pca(vectors, 3), key, unit=False)

    def axis(i: int) -> Column:
        return F.element_at("v", i)

    placed = flat.select(key, axis(1).alias("x"), axis(2).alias("y"),
                         axis(1).alias("x3"), axis(2).alias("y3"), axis(3).alias("z3"))
    return norm_coords(norm_coords(placed, ["x", "y"]), ["x3", "y3", "z3"])
