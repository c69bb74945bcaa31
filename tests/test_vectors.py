import numpy as np
import pytest
from pyspark.sql import functions as F

from semspace.functions import vectors as V
from semspace.operators import affinity as A
from semspace.operators import cluster, reduce
from semspace.operators.nearest import NearestIndex, knn_graph, radius_nearest

RNG = np.random.default_rng(7)


def frame(spark, m, key="idx"):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{key} long, v array<double>")


@pytest.fixture(scope="module")
def crowded():
    """Random vectors, a third of them copies of one, near copies and zero vectors."""
    base = RNG.standard_normal((200, 8))
    copies = np.tile(RNG.standard_normal(8), (120, 1))
    return np.vstack([base, copies, base[:40] + 1e-3, np.zeros((3, 8))])


def brute_knn(m, k):
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_bytes": 0, "block_rows": 30, "query_rows": 50, "pivots": 5}])
def test_knn_is_exact(spark, crowded, limits):
    got = knn_graph(frame(spark, crowded), 5, **limits).toPandas().sort_values(["src", "rank"])
    assert (got["dst"].to_numpy().reshape(-1, 5) == brute_knn(crowded, 5)).all()
    assert (got["src"] != got["dst"]).all()
    assert (got.groupby("src")["sim"].diff().dropna() <= 0).all()


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_bytes": 0}, {"max_broadcast_bytes": 0, "cell_items": 2, "hot_points": 3}])
def test_radius_is_exact(spark, limits):
    held = np.vstack([RNG.random((200, 2)), np.tile([0.5, 0.5], (100, 1)), 0.25 + RNG.random((100, 2)) / 1000, [[4e9, -3e17]]])
    asked = np.vstack([RNG.random((150, 2)), held[:50], [[9, 9]]])

    def points(m, key):
        return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(m)], f"{key} long, x double, y double")

    got = radius_nearest(points(asked, "qid"), points(held, "idx"), 0.05, **limits)
    d2 = ((asked[:, None] - held[None]) ** 2).sum(2)
    want = {i: int(d2[i].argmin()) for i in range(len(asked)) if d2[i].min() < 0.05 * 0.05}
    assert {r["qid"]: r["idx"] for r in got.collect()} == want


def test_radius_is_strict(spark):
    held = spark.createDataFrame([(0, 0.0, 0.0)], "idx long, x double, y double")
    asked = spark.createDataFrame([(0, 0.5, 0.0), (1, 0.25, 0.0)], "qid long, x double, y double")
    assert [r["qid"] for r in radius_nearest(asked, held, 0.5).collect()] == [1]


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_bytes": 0, "block_rows": 20, "pivots": 4}])
def test_search_excludes_and_runs_short(spark, limits):
    held = frame(spark, np.eye(4))
    asked = spark.createDataFrame([(0, [1.0, 0.1, 0.0, 0.0], [0]), (1, [1.0, 0.1, 0.0, 0.0], [0, 1, 2, 3])],
                                  "qid long, v array<double>, exclude array<long>")
    got = NearestIndex(held, **limits).search(asked, 2).collect()
    assert sorted((r["qid"], r["rank"], r["idx"]) for r in got) == [(0, 1, 1), (0, 2, 2)]


def test_search_beyond_the_copies_kept(spark):
    held = frame(spark, np.vstack([np.ones((9, 4)), np.eye(4)]))
    index = NearestIndex(held, copies_kept=2, max_broadcast_bytes=0, block_rows=5)
    asked = frame(spark, np.ones((1, 4)), "qid").withColumn("exclude", F.array(*[F.lit(i).cast("long") for i in (0, 2)]))
    assert [r["idx"] for r in index.search(asked, 5).orderBy("rank").collect()] == [1, 3, 4, 5, 6]
    assert [r["idx"] for r in index.search(frame(spark, np.ones((1, 4)), "qid"), 2).orderBy("rank").collect()] == [0, 1]


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_bytes": 0, "block_rows": 8, "pivots": 2}])
def test_search_of_many_copies(spark, limits):
    held = frame(spark, np.ones((30, 3)))
    got = NearestIndex(held, **limits).search(frame(spark, np.ones((1, 3)), "qid"), 20).collect()
    assert sorted(r["idx"] for r in got) == list(range(20))


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_bytes": 0, "tile_rows": 2}])
def test_affinity_both_ways(spark, limits):
    items = frame(spark, np.array([[1.0, 0.0], [0.0, 1.0]]), "item_id").union(frame(spark, np.array([[1.0, 1.0]]), "item_id"))
    anchors = frame(spark, np.array([[1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]), "anchor_idx")
    got = sorted((r["item_id"], *np.round(r["a"], 6)) for r in A.affinity(items, anchors, **limits).collect())
    half = round(0.5 ** 0.5, 6)
    assert got == [(0, 0.0 + half, half, -half), (0, 1, 0, -1), (1, 0, 1, 0)]
    with pytest.raises(ValueError, match="dense"):
        A.affinity(items, anchors.where("anchor_idx <> 1"), **limits).collect()


def test_few_items_than_neighbours(spark):
    assert knn_graph(frame(spark, np.eye(3)), 10).count() == 6
    assert knn_graph(frame(spark, np.eye(1)), 10).count() == 0


@pytest.fixture(scope="module")
def profile(spark):
    items, anchors = RNG.standard_normal((300, 6)), RNG.standard_normal((9, 6))
    u, w = (m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9) for m in (items, anchors))
    a = u @ w.T
    return frame(spark, items, "item_id"), frame(spark, anchors, "anchor_idx"), a, (a - a.mean(0)) / (a.std(0) + 1e-6)


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_bytes": 0, "tile_rows": 4}])
def test_affinity_both_ways(spark, profile, limits):
    items, anchors, a, _ = profile
    got = A.affinity(items, anchors, **limits).orderBy("item_id").toPandas()
    assert np.allclose(np.stack(got["a"]), a)


def test_zscore_ranking_and_groups(spark, profile):
    items, anchors, a, z = profile
    zs = A.anchor_zscore(A.affinity(items, anchors))
    got = zs.orderBy("item_id").toPandas()
    assert np.allclose(np.stack(got["z"]), z)
    top = A.top_anchors(zs).toPandas().sort_values(["item_id", "rank"])
    assert (top["anchor_idx"].to_numpy().reshape(-1, 3) == np.argsort(-z, axis=1)[:, :3]).all()
    keyed = anchors.withColumn("group_key", F.when(F.col("anchor_idx") < 3, "a").when(F.col("anchor_idx") < 8, "b").otherwise("?"))
    groups = spark.createDataFrame([(0, "a"), (1, "b"), (2, "empty")], "group_idx int, group_key string")
    members = A.group_membership(keyed, groups)
    assert members.where(F.col("group_idx") == -1).count() == 1
    sa = A.group_affinity(zs, members, groups)
    want = np.column_stack([z[:, :3].mean(1), z[:, 3:8].mean(1), np.zeros(len(z))])
    assert np.allclose(np.stack(sa.orderBy("item_id").toPandas()["sa"]), want)
    scaled = np.stack(A.group_minmax(sa).orderBy("item_id").toPandas()["sa01"])
    assert np.allclose(scaled, (want - want.min(0)) / (np.ptp(want, 0) + 1e-6))


def test_ties_go_to_the_lowest_index(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0],)], "s array<double>")
    row = df.select(A.best_index(F.col("s")).alias("b"), A.top_indices(F.col("s"), 3)["idx"].alias("t")).first()
    assert row["b"] == 1 and row["t"] == [1, 2, 3]


def test_spaces_must_agree(spark):
    one = spark.createDataFrame([("m", 2)], "model string, dim int")
    A.check_same_space(one, one)
    with pytest.raises(ValueError):
        A.check_same_space(one, spark.createDataFrame([("m", 3)], "model string, dim int"))


def test_normalise_and_quantise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    rows = [r["n"] for r in df.select(V.l2_normalize(F.col("v")).alias("n")).collect()]
    assert np.allclose(rows, [[0.6, 0.8], [0, 0]])
    q = df.select(V.quantize(F.array(F.lit(0.5), F.lit(-9.0), F.lit(1.5 / 127)), F.lit(1.0)).alias("q")).first()["q"]
    assert q == [64, -127, 2]  # 63.5 and 1.5 round to even


def test_pca_axes(spark):
    m = RNG.standard_normal((400, 6)) * [9, 5, 3, 1, 0.5, 0.1] + 4
    fitted = reduce.fit_pca(frame(spark, m, "item_id"), 4)
    assert np.allclose(fitted.axes.T @ fitted.axes, np.eye(4), atol=1e-8)
    values = np.sort(np.linalg.eigvalsh(np.cov(m.T)))[::-1]
    assert np.allclose(fitted.ratio, values[:4] / values.sum())
    got = np.stack(reduce.apply_pca(frame(spark, m, "item_id"), fitted, "item_id", unit=False)
                   .orderBy("item_id").toPandas()["v"])
    assert np.allclose(got, (m - m.mean(0)) @ fitted.axes)


def test_norm_coords_of_one_item(spark):
    df = spark.createDataFrame([(0, 2.0, 3.0)], "item_id long, x double, y double")
    assert reduce.norm_coords(df, ["x", "y"]).first()[1:] == (0.0, 0.0)


def test_kmeans_finds_planted_clusters(spark):
    centres = RNG.standard_normal((4, 5)) * 20
    m = np.vstack([c + RNG.standard_normal((50, 5)) for c in centres])
    got = cluster.kmeans_clusters(frame(spark, m, "item_id"), k=4).orderBy("item_id").toPandas()["cluster"].to_numpy()
    assert all(len(set(got[i * 50:(i + 1) * 50])) == 1 for i in range(4)) and len(set(got)) == 4
    single = cluster.kmeans_clusters(frame(spark, m[:1], "item_id"), k=24)
    assert single.first()["cluster"] == 0


@pytest.mark.parametrize("limits", [{}, {"max_broadcast_bytes": 0, "tile_rows": 2}])
def test_assignment(spark, limits):
    m, c = RNG.standard_normal((90, 3)), RNG.standard_normal((5, 3))
    got = cluster.assign_centroids(frame(spark, m, "item_id"), frame(spark, c, "anchor_idx"), **limits)
    d2 = ((m[:, None] - c[None]) ** 2).sum(2)
    assert (got.orderBy("item_id").toPandas()["cluster"].to_numpy() == d2.argmin(1)).all()


def test_same_result_with_other_partitioning(spark, crowded):
    items = frame(spark, crowded)
    one, many = items.coalesce(1), items.repartition(8)
    a, b = (sorted(map(tuple, knn_graph(df, 3).collect())) for df in (one, many))
    assert a == b


def test_best_by_blocks_in_single_precision():
    from semspace.functions.arrow import unit_rows
    from semspace.operators import blocks

    rng = np.random.default_rng(8)
    v = unit_rows(rng.standard_normal((2500, 5)))  # more than one block of columns
    v[2300:2400] = v[:100]  # equal ones: the lower id
    v[2400] = v[7] + 1e-8  # apart only in double precision
    ids = np.arange(len(v)) * 3
    q = np.concatenate([v[:150], unit_rows(rng.standard_normal((60, 5)))])
    rows, banned = np.repeat(np.arange(60), 2), np.stack([ids[:60], ids[2300:2360]], 1).ravel()
    banned = np.where(rng.random(120) < 0.5, banned, banned + 1)  # some of them are no items
    scores = q @ v.T
    blocks.mask_excluded(scores, ids, rows, banned)
    at, value = blocks.best_in_single(q, v, v.astype(np.float32), ids, rows, banned)
    want, worth = blocks.best_one(scores, blocks.COSINE_DIGITS)
    assert at.tolist() == want.tolist() and np.allclose(value, worth, atol=2e-9)
    one = blocks.best_in_single(q[:1], v[:1], v[:1].astype(np.float32), ids[:1], np.array([0]), ids[:1])
    assert one[1].tolist() == [-np.inf]  # nothing is left


@pytest.mark.parametrize("rows", [None, 60])
def test_blocks_move_by_groups(spark, monkeypatch, rows):
    from semspace.operators import nearest as N

    m = np.random.default_rng(9).standard_normal((400, 6))
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "idx long, v array<double>")
    moved, beside, pairs = [], N._beside, NearestIndex._pairs
    monkeypatch.setattr(N, "_beside", lambda t, p, *a: moved.append(p.count()) or beside(t, p, *a))
    if rows:
        def small(self, own, *a):
            self.group_rows = self.query_group_rows = rows
            return pairs(self, own, *a)
        monkeypatch.setattr(NearestIndex, "_pairs", small)
    got = knn_graph(items, 5, max_broadcast_bytes=0, block_rows=8, query_rows=8, pivots=20)
    want = knn_graph(items, 5)
    assert sorted((r.src, r.rank, r.dst) for r in got.collect()) == sorted((r.src, r.rank, r.dst) for r in want.collect())
    blocks, groups = 400, 3 if not rows else 8  # at most one block an item; groups of 256 rows (or 60) and a block
    assert max(moved) <= blocks * groups and sum(moved) > 0
    if not rows:
        assert max(moved) < 400  # pairs of single blocks are thousands
