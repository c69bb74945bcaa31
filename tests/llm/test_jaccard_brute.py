"""The n-gram Jaccard join against all pairs: clusters of near copies around and across the threshold, repeated ids,
short and shared texts, and the whole small table."""

import re

import numpy as np
import pytest

from semspace.llm import jaccard


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i: i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                    parent[y] = x
    return sorted((i, len(s), root(i)) for (i, _), s in zip(rows, sets, strict=True))


def result(spark, rows, k, percent):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, k, percent).collect())


def cluster(rng, name, n_words, copies, rates):
    """A text of its own and copies with words replaced, dropped or added, of which some edits are shared."""
    base = [f"{name}{i}" for i in range(n_words)]
    out = [" ".join(base)]
    for c in range(copies):
        words, shared = list(base), rng.random() < 0.5
        for at in sorted(rng.choice(n_words, int(rng.choice(rates)), replace=False), reverse=True):
            kind = rng.integers(3)
            new = f"{name}new{at if shared else (c, at)}".replace(" ", "")
            if kind == 0:
                words[at] = new
            elif kind == 1:
                del words[at]
            else:
                words.insert(at, new)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("k, percent, seed", [(4, 85, 1), (5, 80, 2)])
def test_clusters_of_near_copies(spark, k, percent, seed):
    rng = np.random.default_rng(seed)
    texts = cluster(rng, "a", 200, 70, [0, 1, 2, 4, 6, 8, 10, 14]) + cluster(rng, "b", 90, 30, [0, 1, 2, 3, 4, 5])
    texts += cluster(rng, "c", 12, 10, [0, 1, 2]) + [None, "", " \n", "one two", "ONE two", "one two three four five"]
    texts += [t + " " + " ".join(f"tail{i}x{j}" for j in range(30)) for i, t in enumerate(cluster(rng, "p", 40, 8, [0]))]
    order = rng.permutation(len(texts))
    rows = [(int(i), texts[j]) for i, j in enumerate(order)]
    assert result(spark, rows, k, percent) == brute(rows, k, percent)


def test_repeated_ids_are_one_vertex(spark):
    rng = np.random.default_rng(5)
    one, two = cluster(rng, "a", 60, 6, [1, 2, 3]), cluster(rng, "b", 60, 6, [1, 2, 3])
    rows = [(i, t) for i, t in enumerate(one)] + [(10 + i, t) for i, t in enumerate(two)] + [(3, two[0])]
    assert result(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_whole_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(spark, rows, 5, 80) == brute(rows, 5, 80)
