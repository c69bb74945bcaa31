import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from semspace.operators import text_features as X
from semspace.operators.embed import embed, hashing_embedder

TEXTS = ["The quick brown fox and the quick dog", "quick brown foxes, a dog!", "", "the and of",
         "Brown dog; brown dog; quick_fox 42 é1", "no shared words here whatsoever"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select(
        "doc_id", X.word_ngrams(F.col("text")).alias("terms"))


def test_words_then_pairs(docs):
    terms = {r["doc_id"]: r["terms"] for r in docs.collect()}
    assert terms[0] == ["quick", "brown", "fox", "quick", "dog",
                        "quick brown", "brown fox", "fox quick", "quick dog"]
    assert terms[2] == [] and terms[3] == []
    assert "quick_fox" in terms[4] and "é1" in terms[4] and "42" in terms[4]


def test_weights_by_hand(spark, docs):
    fitted = X.fit_tfidf(docs, min_df=2)
    counts = {r["doc_id"]: Counter(r["terms"]) for r in docs.collect()}
    df = Counter(t for c in counts.values() for t in c)
    vocab = {t for t, n in df.items() if n >= 2}
    assert fitted.terms == sorted(vocab)
    got = {}
    for r in X.tfidf_weights(docs, fitted).collect():
        got.setdefault(r["doc_id"], {})[r["term"]] = r["weight"]
    for doc, c in counts.items():
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(TEXTS)) / (1 + df[t])) + 1) for t, n in c.items() if t in vocab}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        assert got.get(doc, {}) == pytest.approx({t: w / norm for t, w in raw.items()})


def test_vocabulary_cap_breaks_ties_by_term(docs):
    capped = X.vocabulary(docs, min_df=1, max_features=4).collect()
    assert [(r["term"], r["n"]) for r in capped] == [("brown", 4), ("dog", 4), ("quick", 3), ("brown dog", 2)]


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(3)
    m = (rng.random((120, 3)) @ rng.random((3, 40))) * (rng.random((120, 40)) < 0.9)
    rows = [(i, [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for i, r in enumerate(m)]
    sparse = spark.createDataFrame(rows, "doc_id long, indices array<int>, values array<double>").repartition(7)
    fitted = X.fit_lsa(sparse, 40, 3)
    s = np.linalg.svd(m, compute_uv=False)[:3]
    assert np.allclose(fitted.singular_values, s, rtol=1e-3)
    assert (np.diff(fitted.singular_values) <= 0).all()
    scores = X.lsa_scores(sparse, fitted)
    got = np.stack(scores.orderBy("doc_id").toPandas()["v"])
    assert np.allclose(got, m @ fitted.axes)
    explained = X.explained_variance(sparse, scores).first()["explained"]
    assert explained == pytest.approx(got.var(0).sum() / m.var(0).sum())


def test_dimension_is_below_the_vocabulary(docs):
    vectors, explained = X.lsa_embed(docs, dim=256, min_df=2)
    sizes = {len(r["v"]) for r in vectors.collect()}
    assert sizes == {len(X.fit_tfidf(docs, min_df=2).terms) - 1}
    assert 0 < explained.first()["explained"] <= 1 + 1e-9


def test_embed_resumes_and_reports_failures(spark):
    def failing(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return hashing_embedder(4)(texts)

    texts = spark.createDataFrame([("a", "one two"), ("b", "bad"), ("c", "three"), ("d", "four")], "item_id string, text string")
    done = spark.createDataFrame([("c",), ("gone",)], "item_id string")
    rows = {r["item_id"]: r for r in embed(texts, failing, 4, "m", done, workers=1).collect()}
    assert set(rows) == {"a", "b", "d"}
    assert rows["b"]["v"] is None and "refused" in rows["b"]["error"]
    assert np.linalg.norm(rows["a"]["v"]) == pytest.approx(1) and rows["a"]["error"] is None
    with pytest.raises(Exception, match="refused"):
        embed(texts, failing, 4, "m", on_error="raise").collect()
    with pytest.raises(ValueError):
        embed(texts, failing, 4, "m", on_error="ignore")


def test_embed_checks_the_dimension(spark):
    texts = spark.createDataFrame([("a", "one")], "item_id string, text string")
    assert "expected" in embed(texts, hashing_embedder(3), 4, "m").first()["error"]


def test_svd_in_blocks_matches_numpy(spark, monkeypatch):
    from semspace.operators import factor

    monkeypatch.setattr(factor, "TERM_BLOCK", 16)
    rng = np.random.default_rng(4)
    left, right = (np.linalg.qr(rng.standard_normal((n, 6)))[0] for n in (90, 50))
    m = (left * [100, 50, 20, 10, 1, 0.5]) @ right.T  # a decaying spectrum: both ways find the same axes
    m[7] = 0
    rows = [(f"d{i}", [int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r != 0]]) for i, r in enumerate(m)]
    sparse = spark.createDataFrame(rows, "doc_id string, indices array<int>, values array<double>").repartition(5)
    fitted = X.fit_lsa(sparse, 50, 4, local_bytes=0)
    small = X.fit_lsa(sparse, 50, 4)
    assert np.allclose(fitted.singular_values, np.linalg.svd(m, compute_uv=False)[:4], rtol=1e-3)
    assert np.allclose(fitted.singular_values, small.singular_values, rtol=1e-6)
    got = {r["doc_id"]: r["v"] for r in X.lsa_scores(sparse, fitted).collect()}
    want = {r["doc_id"]: r["v"] for r in X.lsa_scores(sparse, small).collect()}
    assert got.keys() == want.keys() and got["d7"] == [0.0] * 4
    assert np.allclose([got[d] for d in sorted(got)], [want[d] for d in sorted(want)], atol=1e-5)


def test_no_cap_and_joined_weights(docs):
    whole = X.fit_tfidf(docs, min_df=1, max_features=None)
    terms = {t for r in docs.collect() for t in r["terms"]}
    assert whole.terms == sorted(terms) and whole.size == len(terms)
    local = {r["doc_id"]: (r["indices"], r["values"]) for r in X.tfidf(docs, whole).collect()}
    joined = {r["doc_id"]: (r["indices"], r["values"]) for r in X.tfidf(docs, whole, local_terms=3).collect()}
    assert local.keys() == joined.keys() == set(range(len(TEXTS)))
    for doc in local:
        assert local[doc][0] == joined[doc][0] and local[doc][1] == pytest.approx(joined[doc][1])


def test_terms_are_counted_in_their_row(spark):
    rows = [(1, ["b", "a", "b"]), (2, ["a"]), (2, ["a", "c"]), (None, ["a"]), (None, ["a", "a"]), (3, []), (4, None), (5, ["b"])]
    docs = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    want = docs.select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    assert sorted(map(str, X.term_counts(docs).collect())) == sorted(map(str, want.collect()))
    once = docs.where("doc_id in (1, 3, 5)")
    assert sorted(map(tuple, X.term_counts(once).collect())) == [(1, "a", 1), (1, "b", 2), (5, "b", 1)]
    assert "Aggregate" not in X.term_counts(once)._jdf.queryExecution().optimizedPlan().toString()  # no term moves


def test_few_terms_are_held_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * n if n >= 0 else None for n in (3, 0, 2, -1, 9, 1, 1)])], names=["terms"])
    parts = list(X._slices([batch], 4))
    assert [p.num_rows for p in parts] == [2, 2, 1, 2]
    assert sum((p.column("terms").to_pylist() for p in parts), []) == batch.column("terms").to_pylist()
