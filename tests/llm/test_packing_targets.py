"""Packing: the closed form against a sequential deficit round, target proportions, carried deficits."""

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from semspace.llm import packing
from semspace.llm.tokens import default_path

DIR = "/root/testdata/sf0.001"


def test_places_equal_a_sequential_schedule():
    totals = {3: 70_001, 5: 9_000, 8: 40, 11: 33_333, 12: 700}
    for weights in (None, {3: 1.0, 5: 1.0, 11: 2.0}, {8: 5.0, 12: 0.0}, {3: 1e-9, 5: 1e9}, {}):
        plan = packing.Schedule(totals, 512, weights=weights)
        quanta = sorted((plan.due(k, j), k, j) for k in range(5) for j in range(int(plan.count[k])))
        at, want = 0, {}
        for _, k, j in quanta:
            want[k, j] = at
            at += int(min((j + 1) * plan.quantum[k], plan.totals[k]) - j * plan.quantum[k])
        assert at == sum(totals.values())
        ks, js = (np.array([q[i] for q in quanta]) for i in (1, 2))
        order = np.random.default_rng(1).permutation(len(ks))
        assert plan.place(ks[order], js[order]).tolist() == [want[k, j] for k, j in zip(ks[order].tolist(), js[order].tolist(), strict=True)]


def test_sources_beyond_the_targets_follow():
    plan = packing.Schedule({0: 5000, 1: 5000, 2: 300}, 512, weights={0: 3.0, 1: 1.0})
    assert plan.place(np.array([2]), np.array([0])).tolist() == [10_000]
    # three to one until queue 0 is empty, then queue 1 alone
    assert plan.owed(np.array([0, 1, 2]), np.full(3, 4000)).round().tolist() == [3000, 1000, 0]
    assert plan.owed(np.array([0, 1, 2]), np.full(3, 10_000)).round().tolist() == [5000, 5000, 0]


def test_targets_hold_in_every_window(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(
        "doc_id", "text", F.element_at(F.array(*map(F.lit, ["a", "b", "c"])), (F.col("doc_id") % 3 + 1).cast("int")).alias("source"))
    docs = docs.union(docs.where("doc_id < 5").select("doc_id", F.lit(None).cast("string"), F.lit(None).cast("string")))
    pieces, left, named = packing.pack_with_deficits(docs, window=512, targets={"a": 5, "b": 3, "c": 2, "absent": 9})
    rows = pieces.collect()
    whole, sizes = Counter(), {}
    for r in rows:
        whole[r.doc_id, r.queue] += r.length
        sizes[r.doc_id, r.queue] = r.doc_tokens
    assert whole == sizes
    totals = Counter()
    for (_, queue), n in sizes.items():
        totals[queue] += n
    a, b, c = (named[s] for s in "abc")
    # all three last until the first of them is empty
    full = int(min(totals[a] / 0.5, totals[b] / 0.3, totals[c] / 0.2) // 512) - 1
    tokens = {(r.sequence_id, r.queue): r for r in left.collect()}
    assert full > 3
    for s in range(full):
        assert sum(tokens[s, q].tokens for q in (a, b, c) if (s, q) in tokens) == 512
    for q, share in ((a, 0.5), (b, 0.3), (c, 0.2)):
        placed = 0
        for s in range(full):  # a quantum has 128 ids at least, so a window of 512 may have none of a small share
            placed += tokens[s, q].tokens if (s, q) in tokens else 0
            assert abs(placed - share * 512 * (s + 1)) <= 512  # what is owed never grows beyond a window
            assert (s, q) not in tokens or tokens[s, q].deficit == pytest.approx(share * 512 * (s + 1) - placed, abs=0.01)
    last = {}
    for r in tokens.values():
        last[r.queue] = max(last.get(r.queue, (-1, 0)), (r.sequence_id, r.deficit))
    assert all(abs(d) < 512 for _, d in last.values())
    # null source, in no target: after all others
    none = named[None]
    assert min(r.sequence_id for r in rows if r.queue == none) >= max(r.sequence_id for r in rows if r.queue != none)
    assert sum(r.tokens for r in tokens.values()) == sum(totals.values())


def test_pieces_are_the_documents_ids(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id is not null")
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    tokenizer = Tokenizer.from_file(default_path())
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in texts.items()}
    names = [r.source for r in docs.select("source").distinct().collect()]
    for targets in (None, {name: i + 1 for i, name in enumerate(names)}):
        rows = packing.pack(docs, targets=targets).collect()
        assert Counter(r.doc_id for r in rows).keys() == ids.keys()
        for r in rows:
            assert zlib.crc32(np.array(ids[r.doc_id][r.start: r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        spans = {}
        for r in rows:
            spans.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and all(x[1] == y[0] for x, y in zip(s[:-1], s[1:], strict=True))
            assert s[-1][1] in {1 << b for b in range(13)}
        assert sum(r.length for r in rows) == sum(map(len, ids.values()))


def test_targets_are_checked(spark):
    docs = spark.createDataFrame([(1, "x", "a")], "doc_id long, text string, source string")
    for bad in ({"a": -1}, {"a": float("nan")}, {"a": float("inf")}, {i: 1 for i in range(packing.MAX_QUEUES + 1)}):
        with pytest.raises(ValueError):
            packing.pack(docs, targets=bad)
