"""Nearest point within a radius by an equi-join on the cells of a hashed grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import materialize
from .skew import hot_keys

CELL_ITEMS = 64  # distinct items of a cell at which the finest grid is fine enough
MAX_HALVINGS = 40
HOT_POINTS = 100_000  # queries of one cell that stay in one task
SLACK = 1.001  # cells are a little wider than the radius, so that rounding moves no neighbour two cells on


def _cell(x: Column, side: float) -> Column:
    """Number of the cell as a double: an outlier may be any number of cells away."""
    q = x / F.lit(side * SLACK)
    return F.when(F.abs(q) < 1e15, F.floor(q).cast("double")).otherwise(q)


def _cells(df: DataFrame, side: float) -> DataFrame:
    return df.withColumns({"cx": _cell(F.col("x"), side), "cy": _cell(F.col("y"), side)})


def _finest(items: DataFrame, radius: float, cell_items: int) -> int:
    """How often to halve the radius until no cell holds more than ``cell_items`` of the distinct items."""
    for halvings in range(MAX_HALVINGS):
        fullest = _cells(items, radius / 2 ** halvings).groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= cell_items:
            return halvings
    return MAX_HALVINGS


def _nearest_in_cells(asked: DataFrame, items: DataFrame, side: float, hot_points: int) -> DataFrame:
    """(x, y, best) of the query points with an item nearer than ``side``: nine cells per point."""
    around = [F.col(c) + d for c in ("cx", "cy") for d in (-1.0, 0.0, 1.0)]
    nine = F.array_distinct(F.array(*[F.struct(a.alias("cx"), b.alias("cy")) for a in around[:3] for b in around[3:]]))
    points = _cells(asked, side).select(F.col("x").alias("qx"), F.col("y").alias("qy"), F.explode(nine).alias("cell"))
    held = _cells(items, side).select("idx", "x", "y", F.struct("cx", "cy").alias("cell"))
    hot = hot_keys(points, "cell", hot_points)
    if hot:
        table = asked.sparkSession.createDataFrame(
            [(tuple(cell), n) for cell, n in hot], "cell struct<cx:double,cy:double>, salts long")
        salts = F.broadcast(table)  # at most 4096 rows
        points = points.join(salts, "cell", "left").withColumn(
            "salt", F.pmod(F.xxhash64("qx", "qy"), F.coalesce("salts", F.lit(1)))).drop("salts")
        held = held.join(salts, "cell", "left").withColumn(
            "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    met = points.join(held, ["cell", "salt"] if hot else ["cell"])
    dx, dy = F.col("qx") - F.col("x"), F.col("qy") - F.col("y")
    met = met.select("qx", "qy", "idx", (dx * dx + dy * dy).alias("d2")).where(F.col("d2") < side * side)
    best = met.groupBy("qx", "qy").agg(F.min(F.struct("d2", "idx")).alias("best"))
    return best.select(F.col("qx").alias("x"), F.col("qy").alias("y"), "best")


def grid_nearest(queries: DataFrame, items: DataFrame, radius: float, cell_items: int = CELL_ITEMS,
                 hot_points: int = HOT_POINTS) -> DataFrame:
    """(qid, idx, dist): the nearest of ``items`` (idx, x, y) strictly within ``radius`` of each of
    ``queries`` (qid, x, y), equal distances to the lower idx.

    Equal points are one point on either side. With cells as wide as the radius whatever is within it lies
    in the nine cells around a point; both sides meet in an equi-join on the cell. Where cells are crowded
    the search starts with a grid halved until they are not, and only points that found nothing within the
    smaller radius go on to the next larger one. Cells with many query points are split by salts. Points
    with a null coordinate find nothing and are not found.
    """
    known = F.col("x").isNotNull() & F.col("y").isNotNull()
    places = materialize(items.where(known).groupBy("x", "y").agg(F.min("idx").alias("idx")), "places")
    points = materialize(queries.where(known).select("x", "y").distinct(), "points")
    found, open_points = None, points
    for halvings in range(_finest(places, radius, cell_items), -1, -1):
        best = materialize(_nearest_in_cells(open_points, places, radius / 2 ** halvings, hot_points), "near")
        found = best if found is None else found.unionByName(best)
        if halvings:
            open_points = materialize(open_points.join(best, ["x", "y"], "left_anti"), "open")
    return queries.join(found, ["x", "y"]).select("qid", "best.idx", F.sqrt("best.d2").alias("dist"))
