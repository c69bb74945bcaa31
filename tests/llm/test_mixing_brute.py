"""The mix against its SQL, its targets and its inclusion probabilities."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from semspace.llm import bindings, mixing

DIR = "/root/testdata/sf0.01"


def test_equals_sql_and_meets_targets(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(con.sql(bindings.OP5_SQL).select(*names).fetchall())
    rows = bindings.QUERIES["op5_pareto_mix"](spark, DIR).collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == want
    by_target = {}
    for r in rows:
        assert r.taken <= 2 * r.size
        have = by_target.setdefault((r.target, r.source_size), [0, 0])
        have[0] += r.taken
        have[1] = max(have[1], r.size)
    assert all(abs(taken - target) <= largest / 2 + 1 for (target, _), (taken, largest) in by_target.items())


def test_inclusion_follows_pi(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + 37 * i % 300), "abc"[i % 3]) for i in range(240)], "doc_id long, text string, source string")
    taken, pi = np.zeros(240), np.zeros(240)
    for seed in range(12):
        rows = mixing.allocate(mixing.sized(docs, ["doc_id", "source"], f"s{seed}")).select(
            "row.*", "pi", (F.col("copies") - F.floor(F.col("target") / F.col("source_size"))).alias("more"), "size", "source_size",
            (F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")).alias("rest")).collect()
        for r in rows:
            taken[r.doc_id] += r.more
            pi[r.doc_id] = r.pi
    for s in "abc":  # expected words are the rest of the target
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.pi * r.size for r in mine) - mine[0].rest) <= 1e-6 * max(1, mine[0].source_size)
    for low, high in ((0, 0.3), (0.3, 0.5), (0.5, 0.7), (0.7, 1)):
        at = (pi > low) & (pi < high)
        if at.sum() >= 20:
            assert abs(taken[at].mean() / 12 - pi[at].mean()) < 0.12


def test_one_source_ties_and_nothing(spark):
    docs = spark.createDataFrame([(7, "a b c", None)] * 5 + [(8, "", None), (None, "d", None)], "doc_id long, text string, source string")
    rows = mixing.allocate(mixing.sized(docs, ["doc_id"])).collect()
    assert len(rows) == 7 and abs(sum(r.copies * r.size for r in rows) - 24) <= 2 and all(r.copies <= 2 for r in rows)
    empty = spark.createDataFrame([(1, None, "x"), (2, " ", "y")], docs.schema)
    assert [r.copies for r in mixing.allocate(mixing.sized(empty, ["doc_id"])).collect()] == [0, 0]
