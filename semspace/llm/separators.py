"""Token counts of documents from flat token files by a separator scan (operator 10).

A flat file is nothing but ids, each document's ids followed by the end-of-document id, without an index;
ids are unsigned 16-bit while the vocabulary permits, else 32-bit, little-endian. The scan cuts files into
blocks of BLOCK ids at fixed places, whatever the documents; each task reads its block and compares it with
the separator as one vector. A block knows its own separators only. Boundaries across blocks are
stitched by a prefix scan in two levels over the blocks' summaries (number of separators, place of the last
one): within groups of GROUP blocks, and over groups. A document is then the ids between two
separators, however many blocks it spans; no document or file is read as a whole.

Ids after the last separator of a file form a last, unclosed document with ``closed`` false. Empty documents
count 0 ids. An empty file has no documents. Special strings in texts are ordinary text here, so that the
separator occurs nowhere else; null texts are empty.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, scratch_path
from .tokens import default_path, encoder

SEPARATOR = 49407
BLOCK = 1 << 19
GROUP = 1024


def _open(folder: str):
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def write_flat(docs: DataFrame, folder: str, path: str, separator: int = SEPARATOR) -> DataFrame:
    """(file, width, doc_id, ordinal, ids): a flat file per task; the rows tell which document was written
    as which of the file, and how long the file was after it (ids)."""

    def write(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        tokenizer = encoder(path, literal=True)
        width = 2 if max(tokenizer.tokenizer.get_vocab_size(), separator + 1) <= 1 << 16 else 4
        context, ordinal, total = TaskContext.get(), 0, 0
        name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.ids"
        with fs.open_output_stream(name, compression=None) as out:
            for batch in batches:
                for lo, ids, offsets in tokenizer.rows(batch.column(1)):
                    rows = len(offsets) - 1
                    ids = np.insert(ids, offsets[1:], np.uint32(separator))
                    out.write(ids.astype(f"<u{width}").data.cast("B"))
                    ends = total + offsets[1:] + np.arange(1, rows + 1)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * rows, pa.string()), pa.array(np.full(rows, width, np.int32)),
                        batch.column(0).slice(lo, rows), pa.array(np.arange(ordinal, ordinal + rows)), pa.array(ends)],
                        ["file", "width", "doc_id", "ordinal", "ids"])
                    ordinal, total = ordinal + rows, total + len(ids)
        tokenizer.clear()  # the process goes on to other tasks

    return docs.select("doc_id", "text").mapInArrow(write, "file string, width int, doc_id long, ordinal long, ids long")


def scan(files: DataFrame, folder: str, separator: int = SEPARATOR, block: int = BLOCK) -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of the documents in ``files`` (file, width, ids)."""
    blocks = files.select("file", "width", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("ids") - 1) / block))).alias(
        "block")).where("ids > 0").repartition("file", "block")

    def search(batches):
        fs, _ = _open(folder)
        for batch in batches:
            for file, width, size, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo = number * block
                n = min(block, size - lo)
                with fs.open_input_file(file) as stream:
                    stream.seek(lo * width)
                    ids = np.frombuffer(stream.read(n * width), f"<u{width}")
                at = np.flatnonzero(ids == separator) + lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([number]), pa.array([len(at)]), pa.array([int(at[-1]) if len(at) else None], pa.int64()),
                     pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([lo + n])],
                    ["file", "block", "n", "last", "at", "end"])

    found = keep(blocks.mapInArrow(search, "file string, block long, n long, last long, at array<long>, end long"), "blocks")
    small = found.select("file", "block", "n", "last", "end").withColumn("grp", F.expr(f"block div {GROUP}"))
    groups = small.groupBy("file", "grp").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    before = Window.partitionBy("file").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.max("last").over(before).alias("last0"))
    inside = Window.partitionBy("file", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = small.select("file", "grp", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n1"),
                           F.max("last").over(inside).alias("last1")).join(groups, ["file", "grp"]).select(
        "file", "block", (F.col("n0") + F.col("n1")).alias("done"), F.coalesce("last1", "last0", F.lit(-1)).alias("carry"))
    stitched = found.join(carried, ["file", "block"])
    begin = F.transform(F.concat(F.array("carry"), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0)))), lambda x: x + 1)
    closed = stitched.where("n > 0").select("file", "done", F.posexplode(F.arrays_zip(begin.alias("start"), F.col("at").alias("stop"))).alias("i", "d"))
    closed = closed.select("file", (F.col("done") + F.col("i")).alias("ordinal"), "d.start",
                           (F.col("d.stop") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = found.groupBy("file").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("end").alias("end"))
    tails = tails.where("end > start").select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tails)


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ordinal, start): ``docs`` written to flat files, counted by the scan alone; the
    documents' names are joined to their ordinals at the end."""
    folder = scratch_path(docs.sparkSession, "llm-flat")
    written = keep(write_flat(docs, folder, path or default_path()), "written")
    files = written.groupBy("file", "width").agg(F.max("ids").alias("ids"))
    counted = scan(files, folder)
    return written.select("file", "ordinal", "doc_id").join(counted, ["file", "ordinal"]).select("doc_id", "n_tokens", "ordinal", "start")
