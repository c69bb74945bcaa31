"""Readers and writers of the engine's tables."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NA_TOKENS, na_to_null
from ..operators.clean import drop_missing, find_score_columns, keep_first, normalize_header

# Headers of the dump (lower case) and the names used here.
CATALOGUE_NAMES = {"tropeid": "item_id", "itemid": "item_id", "item_id": "item_id",
                   "trope": "name", "name": "name", "description": "description"}
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few splits (one small file) one task per core; larger scans stay as they
    are, so nothing is shuffled where the input is big."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def locate_datasets(spark: SparkSession, root: str, name: str) -> list[str]:
    """Folders under ``root`` that hold a file called ``name``; an error if there is none."""
    try:
        hits = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                .option("pathGlobFilter", name).load(root).select("path").collect())
    except AnalysisException as problem:
        raise FileNotFoundError(f"{root}: {problem.getCondition()}") from problem
    if not hits:
        raise FileNotFoundError(f"no {name} under {root}")
    return sorted({os.path.dirname(row["path"]) for row in hits})


def scan_csv(spark: SparkSession, path: str, multiline: bool = False,
             na_tokens: Iterable[str] = NA_TOKENS, ordered: bool = False) -> DataFrame:
    """All columns as text, missing-value tokens as null. ``multiline`` admits quoted line breaks
    but makes each file one split, so large tables should come as many files. ``ordered`` adds
    ``_ord``, the place of a row: file by name, split, row."""
    df = (spark.read.option("header", True).option("multiLine", multiline).option("quote", '"')
          .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
          .option("ignoreTrailingWhiteSpace", False).csv(path))
    tokens = tuple(na_tokens)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                     F.monotonically_increasing_id().alias("row"))
    return df.select(*[na_to_null(F.col(f"`{c}`"), tokens).alias(c) for c in df.columns],
                     *[place.alias("_ord")] * ordered)


def read_catalogue(spark: SparkSession, path: str, order: str | None = None,
                   na_tokens: Iterable[str] = NA_TOKENS) -> DataFrame:
    """items(item_id, name, description, ord): header normalised, rows without id or name
    dropped, first row of each id kept. ``order`` names an order column; without one the order is
    that of the files by name and of the rows in each."""
    raw = normalize_header(scan_csv(spark, path, True, na_tokens, ordered=True), CATALOGUE_NAMES)
    ord_ = F.col(order).cast("long") if order else F.col("_ord")
    items = raw.select("item_id", "name", "description", ord_.alias("ord"))
    return keep_first(drop_missing(items, items.columns, ["item_id", "name"]), ["item_id"], "ord")


def if_exists(read, schema: str | T.StructType, spark: SparkSession) -> DataFrame:
    """The table, or an empty one when its path does not exist."""
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_occurrences(spark: SparkSession, path: str, key: str = "trope_id") -> DataFrame:
    """The id column of one event table; a missing table is empty."""
    def read() -> DataFrame:
        df = normalize_header(scan_csv(spark, path))
        return df.select(F.col(key).alias("item_id"))

    return if_exists(read, "item_id string", spark)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(name, score text, ord); empty when the file or a score column is missing."""
    schema = "name string, score string, ord struct<file: string, split: long, row: long>"

    def read() -> DataFrame:
        df = normalize_header(scan_csv(spark, path, multiline=True, ordered=True))
        name, score = find_score_columns(df.columns)
        if score is None:
            return spark.createDataFrame([], schema)
        return df.select(F.col(f"`{name}`").alias("name"), F.col(f"`{score}`").alias("score"),
                         F.col("_ord").alias("ord"))

    return if_exists(read, schema, spark)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Format by suffix, Parquet when there is none."""
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "parquet")
    return scan_csv(spark, path, multiline=True) if kind == "csv" else spark.read.format(kind).load(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    kind = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "parquet")
    writer = df.write.mode(mode)
    if kind == "csv":
        (writer.option("header", True).option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        writer.format(kind).save(path)


def write_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(item_id, v, model, dim) without the rows that failed."""
    write_table(vectors.where(F.col("v").isNotNull()).select("item_id", "v", "model", "dim"), path, mode)


def vector_manifest(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"),
                       F.max("model").alias("model"))


def anchor_manifest(anchors: DataFrame) -> DataFrame:
    """As above with the anchors' names in order; anchors are a small dimension."""
    names = F.sort_array(F.collect_list(F.struct("anchor_idx", "name")))
    return anchors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"),
                       F.transform(names, lambda a: a["name"]).alias("names"))


def write_points_json(points: DataFrame, meta: DataFrame, path: str, mode: str = "overwrite") -> None:
    points.write.mode(mode).json(f"{path}/points")
    meta.write.mode(mode).json(f"{path}/meta")


def read_points_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/points").orderBy("i")
