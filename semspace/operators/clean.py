"""Cleaning and indexing operators."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import materialize

SMALL_INDEX_ROWS = 1_000_000


def normalize_header(df: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Trim column names and rename those matching a key case-insensitively."""
    names = {k.lower(): v for k, v in (names or {}).items()}
    trimmed = [c.strip() for c in df.columns]
    return df.toDF(*[names.get(c.lower(), c) for c in trimmed])


# How the dump heads its score columns.
SCORE_NAME_HEADER = "Trope"
SCORE_PREFIXES = ("normalizedgenderratio", "gender ratio")


def find_score_columns(columns: Sequence[str], name: str = SCORE_NAME_HEADER,
                       prefixes: Sequence[str] = SCORE_PREFIXES) -> tuple[str, str | None]:
    """The name column (``name`` or else the first) and the score column, picked by prefix.

    The first prefix is compared with blanks removed, the others with the header as it is.
    """
    columns = [c.strip() for c in columns]
    name_column = name if name in columns else columns[0]
    for at, prefix in enumerate(prefixes):
        for c in columns:
            if (c.lower().replace(" ", "") if at == 0 else c.lower()).startswith(prefix):
                return name_column, c
    return name_column, None


def drop_missing(df: DataFrame, columns: Sequence[str], required: Sequence[str]) -> DataFrame:
    return df.select(*columns).dropna(subset=list(required))


def keep_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row per key, the first in ``order``.

    An aggregate rather than a window: it is combined before the shuffle, so a key that holds a
    third of all rows sends one row per task. The hash leads the key so that sorting compares
    numbers, not long texts.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    first = F.min(F.struct(order, *rest)).alias("_first")
    grouped = df.groupBy(F.xxhash64(*keys).alias("_hash"), *keys).agg(first)
    return grouped.select(*keys, "_first.*").select(*df.columns)


def optional_column(df: DataFrame, name: str, default: Any = None) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def first_n(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in order, all of them when ``n`` is 0."""
    return df.orderBy(order).limit(n) if n else df.orderBy(order)


def dense_index(df: DataFrame, order: Sequence[str], index: str = "idx",
                small_rows: int = SMALL_INDEX_ROWS, rows: int | None = None) -> DataFrame:
    """Add a dense 0-based row index in ``order`` (which must be a total order). ``rows``: the
    number of rows when it is known, which saves counting them.

    Up to ``small_rows`` rows a plain window does it. Beyond, the rows are range-sorted across
    tasks and each gets its position within the task plus the rows of the tasks before.
    """
    if rows is None:
        rows = df.limit(small_rows + 1).count()
    if rows <= small_rows:
        position = F.row_number().over(Window.orderBy(*order)) - 1
        return df.withColumn(index, position.cast("long"))
    placed = materialize(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    task = F.shiftright("_at", 33)
    sizes = placed.groupBy(task.alias("_task")).count()  # one row per sort task
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return (placed.withColumn("_task", task).join(F.broadcast(starts), "_task")
            .withColumn(index, (F.col("_start") + within).cast("long"))
            .drop("_task", "_at", "_start"))


def row_parity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side; empty when both hold the same keys."""
    left, right = left.select(key).distinct(), right.select(key).distinct()
    only_left = left.join(right, key, "left_anti").withColumn("side", F.lit("left"))
    only_right = right.join(left, key, "left_anti").withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)
