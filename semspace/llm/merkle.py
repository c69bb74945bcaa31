"""Merkle dataset manifest over a SHA midstate tree (operator 13).

Rows are leaves; per tree (here: per language) they ascend by id, every 8 consecutive nodes become their
parent until one node is left, the subroot; the subroots of all trees form a last tree with the root. A
node is the SHA-256 of its children's digests as hex text.

A parent retains, before each child slot, a copy of its hash state. To fold a changed child the matching
state is resumed with the replacement and the right siblings only; what stands left of it is never
hashed again, and all children of a parent share its states. The tree is built in subtrees of three
levels (512 nodes), one group of bounded size each: a round of subtrees per three levels goes up, then
the same rounds go down, and each subtree gets the one path that all its nodes share from there to the
root. So a hot tree is as many groups as it has subtrees, and nothing but one row per tree and partition
meets in one place.

Positions come from a sort by range and the counts of its partitions. Rows with equal ids stand in the
order of their digests, null ids come first. A null tree key is a tree of its own and comes first; trees
are ordered by the UTF-8 bytes of their key. A leaf names null as ``-`` and any value by its byte count,
so that null, empty and the text ``-`` differ. Texts may be of any length and never leave the JVM. An
empty table has no rows and no root. Further columns are not part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

FAN = 8
LEVELS = 3
BLOCK = FAN ** LEVELS
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# a path: for every level from below, the siblings to the left and to the right as hex text
_PATH = "array<struct<`left`:string,`right`:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def is_tampered(doc_id: Column) -> Column:
    """3 divides the CRC-32 of the decimal id; a null id is never tampered with."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, id, digest, changed): the leaf of every row, and of its tampered form, null where it is the same."""
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", *LOWER)
    return docs.select(
        F.col("lang").cast("string").alias("tree"), F.col("doc_id").cast("long").alias("id"),
        leaf(*parts, F.col("text")).alias("digest"),
        F.when(is_tampered(F.col("doc_id")) & (F.col("text") != lower), leaf(*parts, lower)).alias("changed"))


def positions(nodes: DataFrame) -> DataFrame:
    """Nodes (tree, id, digest, ...) with ``pos``, their number inside their tree from 0, and ``size``, the
    number of nodes of the tree. Sorted by range; a tree costs one count per partition that it is in."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = nodes.repartitionByRange(parts, F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_first(), "digest")
    ordered = ordered.sortWithinPartitions(F.col("tree").asc_nulls_first(), F.col("id").asc_nulls_first(), "digest")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, task), pa.int32()), pa.array(np.arange(seen, seen + n), pa.int64())],
                names=[*batch.schema.names, "part", "at"])
            seen += n

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in nodes.schema.fields)}, part int, `at` long"
    ordered = keep(ordered.mapInArrow(number, schema), "ordered")
    counts = ordered.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("begin"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begin")).alias("shift"),
                           F.sum("n").over(whole).alias("size"))
    counts = counts.withColumnsRenamed({"tree": "_tree", "part": "_part"})
    same = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("part") == F.col("_part"))
    return ordered.join(counts, same).withColumn("pos", F.col("at") + F.col("shift")).drop("_tree", "_part", "part", "at", "shift")


def _runs(nodes: list[str]) -> list[list[str]]:
    return [nodes[i: i + FAN] for i in range(0, len(nodes), FAN)]


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def subtree(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels of a subtree from below, its top last; ``whole``: it is a whole tree, which ends as
    soon as one node is left."""
    made = [nodes]
    for _ in range(LEVELS):
        if whole and len(made[-1]) == 1:
            break
        made.append([digest_of(*run) for run in _runs(made[-1])])
    return made


def retained(run: list[str]) -> list:
    """The hash states of a parent before each of its child slots."""
    state, states = hashlib.sha256(), []
    for child in run:
        states.append(state.copy())
        state.update(child.encode())
    return states


def resumed(state, replacement: str, right: str) -> str:
    state = state.copy()
    state.update(replacement.encode())
    state.update(right.encode())
    return state.hexdigest()


class Folding:
    """Folds nodes of one subtree up to the root: states per parent below, one state per level above."""

    def __init__(self, levels: list[list[str]], above: list[dict]):
        self.runs = [_runs(level) for level in levels[:-1]]
        self.states = [[retained(run) for run in level] for level in self.runs]
        self.above = [(x["left"], x["right"], hashlib.sha256(x["left"].encode())) for x in above]
        self.tail = "".join(x["left"] + x["right"] for x in above)

    def path(self, at: int) -> list[tuple[str, str]]:
        below = []
        for level in self.runs:
            run, slot = level[at // FAN], at % FAN
            below.append(("".join(run[:slot]), "".join(run[slot + 1:])))
            at //= FAN
        return below + [(left, right) for left, right, _ in self.above]

    def root(self, at: int, value: str) -> str:
        for level, states in zip(self.runs, self.states, strict=True):
            run, slot = level[at // FAN], at % FAN
            value = resumed(states[at // FAN][slot], value, "".join(run[slot + 1:]))
            at //= FAN
        for _, right, state in self.above:
            value = resumed(state, value, right)
        return value

    def proof(self, at: int) -> str:
        below = []
        for level in self.runs:
            run, slot = level[at // FAN], at % FAN
            below += run[:slot] + run[slot + 1:]
            at //= FAN
        return digest_of(*below, self.tail)


def _levels_up(nodes: DataFrame) -> DataFrame:
    """One round: the tops of the subtrees of (tree, pos, size, digest), as nodes of the next round."""
    def top(key: tuple, group: pa.Table) -> pa.Table:
        digests = group.sort_by("pos")["digest"].to_pylist()
        size = group["size"][0].as_py()
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()),
                         "size": pa.array([-(-size // BLOCK)], pa.int64()),
                         "digest": subtree(digests, size <= BLOCK)[-1]})

    blocks = nodes.select("tree", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "size", "digest")
    return blocks.groupBy("tree", "block").applyInArrow(top, "tree string, pos long, size long, digest string")


def _levels_down(nodes: DataFrame, tops: DataFrame, work, schema: str) -> DataFrame:
    """``work(group, folding)`` for every subtree of ``nodes``, given the tops (tree, pos, path, ...)."""
    def run(key: tuple, group: pa.Table, top: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        size = group["size"][0].as_py()
        folding = Folding(subtree(group["digest"].to_pylist(), size <= BLOCK), top["path"][0].as_py() or [])
        return work(group, top, folding)

    left = nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).groupBy("tree", "block")
    return left.cogroup(tops.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(run, schema)


def _paths(group: pa.Table, top: pa.Table, folding: Folding) -> pa.Table:
    paths = [[{"left": a, "right": b} for a, b in folding.path(i)] for i in range(group.num_rows)]
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    out = group.select(["tree", "pos"]).append_column("path", pa.array(paths, kind))
    for name in ("subroot", "root"):
        out = out.append_column(name, pa.array([top[name][0].as_py()] * group.num_rows, pa.string()))
    return out


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of every round from below; those of the last are single, one per tree."""
    rounds = [nodes]
    while True:
        tall = rounds[-1].agg(F.max("size")).first()[0]
        if tall is None or (tall == 1 and len(rounds) > 1):
            return rounds
        rounds.append(keep(_levels_up(rounds[-1]), "tops"))


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """From the paths of the last round to the paths of those one round above the first."""
    for nodes in rounds[-2:0:-1]:
        tops = keep(_levels_down(nodes, tops, _paths, f"tree string, pos long, path {_PATH}, subroot string, root string"), "paths")
    return tops


def manifest(nodes: DataFrame) -> DataFrame:
    """(tree, id, leaf, subroot, root, proof_sha256, folded_root) of leaves (tree, id, digest, changed):
    ``folded_root`` is the root that the changed leaf, else the leaf itself, gives with its siblings."""
    placed = keep(positions(nodes), "leaves")
    rounds = _climb(placed)
    # the last tree: the subroots in the order of their keys
    subroots = rounds[-1].select(F.lit("").alias("tree"), F.hex(F.encode("tree", "utf-8")).alias("id"), "digest", F.col("tree").alias("of"))
    subroots = keep(positions(subroots), "subroots")
    last = _climb(subroots)
    crown = last[-1].select("tree", "pos", F.lit(None).cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    if len(last) > 1:
        crown = _levels_down(last[0], _descend(last, crown), _paths, f"tree string, pos long, path {_PATH}, subroot string, root string")
    named = subroots.select("pos", F.col("of").alias("tree"), F.col("digest").alias("subroot")).join(
        crown.select("pos", "path", "root"), "pos")
    tops = keep(named.select("tree", F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"), "crown")

    def finish(group: pa.Table, top: pa.Table, folding: Folding) -> pa.Table:
        n = group.num_rows
        leaf_of, changed = group["digest"].to_pylist(), group["changed"].to_pylist()
        return pa.table({
            "tree": group["tree"], "id": group["id"], "leaf": group["digest"],
            "subroot": pa.array([top["subroot"][0].as_py()] * n, pa.string()), "root": pa.array([top["root"][0].as_py()] * n, pa.string()),
            "proof_sha256": pa.array([folding.proof(i) for i in range(n)], pa.string()),
            "folded_root": pa.array([folding.root(i, changed[i] or leaf_of[i]) for i in range(n)], pa.string())})

    return _levels_down(rounds[0], _descend(rounds, tops), finish,
                        "tree string, id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")


def document_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per document."""
    return manifest(leaves(docs)).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
