"""CSV dump -> item feature table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..functions.scores import MEDIA
from ..operators import features as X
from ..operators.clean import keep_first
from ..sources import tables


def feature_table(items: DataFrame, events: dict[str, DataFrame], scores: DataFrame) -> DataFrame:
    """``items``: (item_id, name, description); ``events``: medium -> (item_id); ``scores``:
    (name, score text, ord)."""
    counted = X.feature_counts(items.select("item_id", "name", "description"), X.occurrences(events))
    scored = X.name_score_lookup(X.dominant_medium(X.media_mix(counted)), scores)
    counts = [f"n_{m}" for m in MEDIA]
    shares = [f"frac_{m}" for m in MEDIA]
    return scored.select("item_id", "name", "description", *counts, "n_total", *shares,
                         "dominant_media", "gender_ratio")


# File names of the dump.
CATALOGUE_FILE = "tropes.csv"
EVENT_FILES = {"film": "film_tropes.csv", "tv": "tv_tropes.csv", "lit": "lit_tropes.csv"}
SCORE_FILE = "genderedness_filtered.csv"


def build(spark: SparkSession, root: str, out: str, catalogue: str = CATALOGUE_FILE,
          events: dict[str, str] | None = None, scores: str = SCORE_FILE) -> DataFrame:
    """Find the dump under ``root``, build the table, write it to ``out``. A dump may lie in several
    folders: their tables are one, of items with one id the first by folder, file and row stays."""
    events = events or EVENT_FILES
    folders = tables.locate_datasets(spark, root, catalogue)

    def whole(read, name: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [read(spark, f"{folder}/{name}") for folder in folders])

    table = feature_table(
        keep_first(whole(tables.read_catalogue, catalogue), ["item_id"], "ord"),
        {m: whole(tables.read_occurrences, name) for m, name in events.items()},
        whole(tables.read_scores, scores))
    tables.write_table(table, out)
    return tables.read_table(spark, out)
