import numpy as np
import pytest
from pyspark.sql import functions as F

from semspace.operators import compose as M
from semspace.operators import explore as X
from semspace.operators import nearest as N
from semspace.operators.blocks import best_one
from semspace.operators.nearest import NearestIndex
from semspace.plans import craft, project

RNG = np.random.default_rng(11)
BLOCKS = {"max_broadcast_bytes": 0, "block_rows": 16, "query_rows": 64, "pivots": 4}


def unit(m):
    return m / (np.linalg.norm(m, axis=-1, keepdims=True) + 1e-9)


def frame(spark, m, key):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], f"{key} long, v array<double>")


def nearest(v, s, banned=()):
    scores = np.round(unit(s) @ v.T, 9)
    scores[list(banned)] = -9
    return int(scores.argmax())


def model_closure(v, r):
    """The closure in plain numpy, as the check of the distributed one."""
    parents, frontier = {}, []
    for i in range(len(r)):
        for j in range(i, len(r)):
            hit = nearest(v, r[i] + r[j])
            if hit not in parents:
                parents[hit] = (0, i, 0, j)
                frontier.append(hit)
    anchors, hubs = [(0, i, r[i]) for i in range(len(r))], set()
    used, width = anchors, 1
    while True:
        new = 0
        while frontier:
            found = []
            for kind, idx, a in used:
                for f in frontier:
                    hit = nearest(v, v[f] + a, (f, idx) if kind else (f,))
                    if hit not in parents:
                        parents[hit] = (1, f, kind, idx)
                        found.append(hit)
            frontier, used, new = found, anchors, new + len(found)
        if hubs and not new:
            width *= 2
        missing = [i for i in range(len(v)) if i not in parents]
        have = np.array([i for i in sorted(parents) if i not in hubs], int)
        if not missing or not len(have):
            return parents
        best = np.argsort(-np.round(v[missing] @ v[have].T, 9), axis=1, kind="stable")[:, :width]
        used = [(1, h, v[h]) for h in sorted(set(have[best].ravel().tolist()))]
        hubs |= {h for _, h, _ in used}
        anchors = anchors + used
        frontier = sorted(parents)


def fixed_point(v, r):
    """Everything that pairs of reached elements reach, whatever the order."""
    def hits(base, own, a):
        scores = np.round(unit(base + a) @ v.T, 9)
        scores[np.arange(len(base))[:, None], own] = -9
        return set(scores.argmax(1).tolist())

    reached = {nearest(v, a + b) for a in r for b in r}
    while True:
        have = np.array(sorted(reached))
        new = set().union(*[hits(v[have], have[:, None], a) for a in r])
        for h in have:
            new |= hits(v[have], np.stack([have, np.full(len(have), h)], axis=1), v[h])
        if new <= reached:
            return reached
        reached |= new


def clustered(n, dim, centres, spread):
    rng = np.random.default_rng(5)
    return unit(unit(rng.standard_normal((centres, dim)))[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, dim)))


@pytest.mark.parametrize("hub_step", [400, 15])
def test_closure_leaves_nothing_reachable_out(spark, hub_step):
    v, r = clustered(40, 8, 4, 0.05), unit(np.random.default_rng(6).standard_normal((4, 8)))
    done = M.reach_closure(frame(spark, v, "item_idx"), frame(spark, r, "seed_idx"), hub_step=hub_step)
    got = {row["item_idx"] for row in done.recipes.where("a_kind is not null").collect()}
    assert got == fixed_point(v, r)


@pytest.mark.parametrize("index", [{}, BLOCKS])
def test_closure_equals_the_model(spark, index):
    v, r = unit(RNG.standard_normal((14 if index else 40, 6))), unit(RNG.standard_normal((3, 6)))
    done = M.reach_closure(frame(spark, v, "item_idx"), frame(spark, r, "seed_idx"), **index)
    got = {row["item_idx"]: (row["a_kind"], row["a_idx"], row["b_kind"], row["b_idx"])
           for row in done.recipes.where("a_kind is not null").collect()}
    assert got == model_closure(v, r)
    assert done.recipes.count() == done.total == len(v) and done.reached == len(got)


@pytest.mark.parametrize("cells", [None, 2000])
def test_settled_items_are_not_searched_again(spark, monkeypatch, cells):
    v, r = unit(np.random.default_rng(3).standard_normal((40, 6))), unit(np.random.default_rng(6).standard_normal((3, 6)))
    if cells:
        monkeypatch.setattr(M, "RUN_CELLS", cells)  # a few anchors a run
    left, expand = [], M.expand_round
    monkeypatch.setattr(M, "expand_round", lambda *a, **k: left.append((~a[3].flags).sum()) or expand(*a, **k))
    done = M.reach_closure(frame(spark, v, "item_idx"), frame(spark, r, "seed_idx"))
    got = {row["item_idx"]: (row["a_kind"], row["a_idx"], row["b_kind"], row["b_idx"])
           for row in done.recipes.where("a_kind is not null").collect()}
    assert got == model_closure(v, r)
    assert done.reached == len(v) and min(left) > 0  # no round once everything is reached


@pytest.mark.parametrize("together", [(256, 32), (7, 3)])
def test_first_hits_equal_those_of_all_scores(monkeypatch, together):
    monkeypatch.setattr(M, "ROWS_TOGETHER", together[0])
    monkeypatch.setattr(M, "ANCHORS_TOGETHER", together[1])
    rng = np.random.default_rng(12)
    v = unit(rng.standard_normal((3000, 6)))  # more than one block of columns
    v[2900:2950] = v[:50]  # equal ones: the lower id
    v[2950] = v[7] + 1e-8  # apart only in double precision
    v[2951] = -v[40]
    ids = np.arange(len(v)) * 3 + 1
    own = rng.permutation(len(v))[:40]
    own[0], own[1] = 40, 2951
    item = np.concatenate([[2951, 40], rng.permutation(len(v))[:8]])
    kinds = np.concatenate([[0, 0], np.ones(len(item), int)])
    anchors = np.concatenate([rng.standard_normal((2, 6)) * 5, v[item]])  # seeds need not be of unit length
    anchor_ids = np.concatenate([[0, 1], ids[item]])
    done = rng.random(len(v)) < 0.6
    want = {}
    for j, a in enumerate(anchors):
        scores = unit(unit(v[own] + a)) @ v.T
        scores[np.arange(len(own)), own] = -np.inf
        if kinds[j]:
            scores[:, item[j - 2]] = -np.inf
        for at, hit in enumerate(best_one(scores, 9)[0]):
            if not done[hit]:
                want.setdefault(int(ids[hit]), ((5 + j << M.ORDER_BITS) + at, int(ids[own[at]]), int(kinds[j]), int(anchor_ids[j])))
    got = M._first_hits(ids[own], np.arange(len(own)), (ids, v), (anchors, kinds, anchor_ids), 5, done).to_pylist()
    assert {r["item_idx"]: (r["key"], r["a_idx"], r["b_kind"], r["b_idx"]) for r in got} == want


@pytest.mark.parametrize("cells", [None, 100_000])
def test_rounds_write_no_tables_where_items_are_in_every_task(spark, monkeypatch, cells):
    v, r = unit(np.random.default_rng(3).standard_normal((40, 6))), unit(np.random.default_rng(6).standard_normal((3, 6)))
    if cells:
        monkeypatch.setattr(M, "HERE_CELLS", 0)  # every round in tasks, a few anchors a run
        monkeypatch.setattr(M, "RUN_CELLS", cells)
    written, jobs, write, tasks = [], [], M.materialize, M._hits_in_tasks
    monkeypatch.setattr(M, "materialize", lambda df, name="table": written.append(name) or write(df, name))
    monkeypatch.setattr(M, "_hits_in_tasks", lambda *a: jobs.append(a[2]) or tasks(*a))
    done = M.reach_closure(frame(spark, v, "item_idx"), frame(spark, r, "seed_idx"))
    got = {row["item_idx"]: (row["a_kind"], row["a_idx"], row["b_kind"], row["b_idx"])
           for row in done.recipes.where("a_kind is not null").collect()}
    assert got == model_closure(v, r)
    assert done.rounds > 2 and set(written) == {"universe", "anchors"}  # was one table and some jobs a round
    assert len(jobs) > done.rounds if cells else not jobs


def test_unreachable_items_are_reported(spark):
    v = unit(np.array([[1, 0.0], [1, 0.1], [1, -0.1], [-1, 0.0]]))  # nothing points away from the seed
    done = M.reach_closure(frame(spark, v, "item_idx"), frame(spark, np.array([[1.0, 0.0]]), "seed_idx"))
    assert done.reached < done.total
    assert done.recipes.where("a_kind is null").count() == done.total - done.reached
    with pytest.raises(ValueError):
        done.require_complete()
    kinds = frame(spark, v, "item_idx").withColumn("kind", F.lit("item"))
    cover = M.coverage_by_kind(kinds, done.recipes.where("a_kind is not null"))
    assert {r["kind"]: r["coverage"] for r in cover.collect()} == pytest.approx(
        {"item": done.reached / 4, None: done.reached / 4})


def test_closure_of_nothing(spark):
    none = frame(spark, np.eye(2), "item_idx").where("item_idx < 0")
    done = M.reach_closure(none, frame(spark, np.eye(2), "seed_idx"))
    assert (done.total, done.reached, done.recipes.count()) == (0, 0, 0)


def test_colliding_seed_pairs_keep_the_first(spark):
    seeds = np.array([[1.0, 0.0], [0.9, 0.1], [0.95, 0.05]])
    index = NearestIndex(frame(spark, unit(np.array([[1.0, 0.05], [-1.0, 0.0]])), "idx"))
    hits = M.seed_recipes(frame(spark, seeds, "seed_idx"), index).collect()
    assert [(h["item_idx"], h["a_idx"], h["b_idx"]) for h in hits] == [(0, 0, 0)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_combine_excludes_item_inputs_only(spark, hot_rows):
    v, r = unit(RNG.standard_normal((30, 4))), unit(RNG.standard_normal((2, 4)))
    items, seeds = frame(spark, v, "item_idx"), frame(spark, r, "seed_idx")
    asked = [("i3", "i4"), ("i3", "i3"), ("r0", "i5"), ("r0", "r1"), ("i3", "i9"), ("i3", "r1")]
    pairs = spark.createDataFrame([(i, *p) for i, p in enumerate(asked)], "pair_id long, a_key string, b_key string")
    index = NearestIndex(items.withColumnRenamed("item_idx", "idx"))
    got = {row["pair_id"]: row["result_idx"]
           for row in M.combine_pairs(pairs, M.elements(seeds, items), index, hot_rows).collect()}

    def vec(key):
        return (r if key[0] == "r" else v)[int(key[1:])]

    assert got == {i: nearest(v, vec(a) + vec(b), [int(k[1:]) for k in (a, b) if k[0] == "i"])
                   for i, (a, b) in enumerate(asked)}


@pytest.mark.parametrize("index", [{}, {"max_broadcast_bytes": 0}])
def test_pairs_in_slices_and_shares_of_bounded_size(spark, monkeypatch, index):
    rng = np.random.default_rng(14)
    v, r = unit(rng.standard_normal((300, 4))), unit(rng.standard_normal((2, 4)))
    v[290:] = v[:10]  # equal ones, in other shares
    v[20] = -v[30]
    items, seeds = frame(spark, v, "item_idx"), frame(spark, r, "seed_idx")
    keys = [f"i{i}" for i in range(300)] + ["r0", "r1", "i999", None]
    asked = [(keys[i], keys[j]) for i, j in rng.integers(0, 304, (400, 2))] + [("i7", f"i{j}") for j in range(290)] + [("i20", "i30")]
    pairs = spark.createDataFrame([(f"p{i}", *p) for i, p in enumerate(asked + asked[:5])], "pair_id string, a_key string, b_key string")
    monkeypatch.setattr(M, "SLICE_PAIRS", 200)
    monkeypatch.setattr(M, "CELL_PAIRS", 60)
    monkeypatch.setattr(M, "CHUNK_PAIRS", 64)
    monkeypatch.setattr(N, "SHARE_BYTES", 3000)  # four shares
    made, gone, write, drop = [], [], M.materialize, M.discard
    monkeypatch.setattr(M, "materialize", lambda df, name="table": made.append(name) or write(df, name))
    monkeypatch.setattr(M, "discard", lambda *t: gone.extend(t) or drop(*t))
    found = M.combine_pairs(pairs, M.elements(seeds, items), NearestIndex(items.withColumnRenamed("item_idx", "idx"), **index))
    got = {row["pair_id"]: (row["result_idx"], row["score"]) for row in found.collect()}

    def vec(key):
        return (r if key[0] == "r" else v)[int(key[1:])]

    want = {}
    for i, (a, b) in enumerate(asked + asked[:5]):
        if a and b and "i999" not in (a, b):
            at = nearest(v, vec(a) + vec(b), [int(k[1:]) for k in (a, b) if k[0] == "i"])
            want[f"p{i}"] = at, pytest.approx(float(unit(vec(a) + vec(b)) @ v[at]), abs=5e-9)
    assert got == want
    slices = made.count("chunks")
    assert slices == 4 and len(gone) >= slices  # vectors of a quarter of the pairs at once; was those of all


def test_memo_answers_each_unordered_pair_once(spark):
    v = unit(RNG.standard_normal((12, 3)))
    items = frame(spark, v, "item_idx")
    index = NearestIndex(items.withColumnRenamed("item_idx", "idx"))
    seeds = frame(spark, v[:1], "seed_idx")
    asked = spark.createDataFrame([("i1", "i2"), ("i2", "i1"), ("i3", "i10"), ("i4", "i5")], "a_key string, b_key string")
    memo = spark.createDataFrame([("i4+i5",)], "pair_id string")
    got = M.combine_memo(asked, memo, M.elements(seeds, items), index).collect()
    assert sorted(r["pair_id"] for r in got) == ["i1+i2", "i10+i3"]


def test_discoveries(spark):
    results = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 5)], "user_id long, item_idx long")
    have = spark.createDataFrame([(1, 6), (2, 7)], "user_id long, item_idx long")
    assert sorted(map(tuple, M.new_discoveries(results, have).collect())) == [(1, 5), (2, 5)]


def test_recipe_lookup_flags(spark):
    schema = "item_idx long, a_kind int, a_idx long, b_kind int, b_idx long"
    recipes = spark.createDataFrame([(5, 0, 0, 0, 1), (6, 1, 5, 0, 1), (7, None, None, None, None)], schema)
    names = spark.createDataFrame([("r0", "R0"), ("r1", "R1"), ("i5", "five")], "key string, name string")
    asked = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (2, 7)], "user_id long, item_idx long")
    have = spark.createDataFrame([(1, 5)], "user_id long, item_idx long")
    for hot_rows in (1_000_000, 1):
        got = {(r["user_id"], r["item_idx"]): tuple(r)[2:] for r in X.recipe_lookup(asked, recipes, names, have, hot_rows).collect()}
        assert got[1, 5] == ("r0", "R0", True, "r1", "R1", True)
        assert got[1, 6] == ("i5", "five", True, "r1", "R1", True)
        assert got[2, 6] == ("i5", "five", False, "r1", "R1", True)
        assert got[2, 7] == (None,) * 6


def test_searches_need_a_query(spark):
    points = spark.createDataFrame([(0, "Ring", 3), (1, "string", 9), (2, "rope", 1)], "i long, name string, tot long")
    assert [r["i"] for r in X.search_items(points, " RING ").collect()] == [1, 0]
    assert X.search_items(points, "  ").count() == 0
    items = points.withColumnRenamed("i", "item_idx")
    none = spark.createDataFrame([(1,)], "item_idx long")
    assert [r["item_idx"] for r in X.undiscovered_search(items, none, "ring").collect()] == [0]
    assert X.undiscovered_search(items, none, "r").count() == 0


def test_palette_cuts_long_sections(spark):
    found = spark.range(1000).select(F.lit(1).alias("user_id"), F.when(F.col("id") < 900, "item").otherwise("word").alias("kind"),
                                     F.col("id").alias("item_idx"), F.lpad(F.col("id").cast("string"), 4, "0").alias("name"))
    got = X.palette_sections(found, keep=400)
    sizes = {(r["kind"], r["section_size"]): r["n"] for r in got.groupBy("kind", "section_size").agg(F.count("*").alias("n")).collect()}
    assert sizes == {("item", 900): 400, ("word", 100): 100}
    assert X.palette_sections(found, query="0007").count() == 1
    roots = spark.createDataFrame([(1, "Water"), (0, "Fire 0007")], "seed_idx long, name string")
    users = spark.createDataFrame([(1,), (2,)], "user_id int")  # the second has found nothing yet
    whole = X.palette_sections(found, keep=400, roots=roots, users=users)
    assert [tuple(r) for r in whole.where("kind = 'root'").select("user_id", "name", "rank", "section_size").orderBy("user_id", "rank").collect()] == [
        (1, "Fire 0007", 1, 2), (1, "Water", 2, 2), (2, "Fire 0007", 1, 2), (2, "Water", 2, 2)]
    hits = X.palette_sections(found, query="0007", roots=roots, users=users).collect()
    assert sorted((r["user_id"], r["kind"], r["section_size"]) for r in hits) == [(1, "item", 1), (1, "root", 1), (2, "root", 1)]
    assert X.palette_sections(found, query="none such", roots=roots).count() == 0


def test_axis_remap_falls_back_to_the_layout(spark):
    schema = "i long, x3 double, y3 double, z3 double, nf long, nt long, nl long, tot long, g double, c int, sa array<double>"
    points = spark.createDataFrame([(0, 0.1, 0.2, 0.3, 1, 1, 0, 2, None, 23, [0.0, 1.0]), (1, 0.0, 0.0, 0.0, 0, 0, 0, 0, -0.5, 0, [0.5, 0.5])], schema)
    metrics = X.axis_metrics(points, 24, groups=2)
    rows = {r["i"]: r for r in metrics.collect()}
    assert (rows[0]["film"], rows[0]["pop"], rows[0]["score"], rows[0]["cluster"], rows[0]["sg1"]) == (0, 1, 0, 1, 1)
    assert (rows[1]["film"], rows[1]["pop"], rows[1]["score"], rows[1]["cluster"]) == (-1, -1, -0.5, -1)
    moved = {r["i"]: tuple(r)[1:] for r in X.axis_remap(metrics, "sg1", "unknown", "flat").collect()}
    assert moved[0] == pytest.approx((60, 12, 0))


def test_craft_plan_end_to_end(spark):
    def part(n, key="ord"):
        m = RNG.standard_normal((n, 10))
        return spark.createDataFrame([(i, f"n{i}", [float(x) for x in row]) for i, row in enumerate(m)],
                                     f"{key} long, name string, v array<double>")

    made = craft.build(part(4), part(5), part(15), part(4, "seed_idx"), dim=5, require_complete=False)
    rows = made.universe.orderBy("item_idx").toPandas()
    assert list(rows["kind"]) == ["word"] * 4 + ["genre"] * 5 + ["item"] * 15
    assert list(rows["item_idx"]) == list(range(24))
    v, r = np.stack(rows["v"]), np.stack(made.seeds.orderBy("seed_idx").toPandas()["v"])
    assert max(abs(x) for q in rows["q"] for x in q) <= 127
    for row in made.closure.recipes.where("a_kind is not null").collect():  # replay
        a, b = ((r if row[f"{s}_kind"] == 0 else v)[row[f"{s}_idx"]] for s in "ab")
        banned = [row[f"{s}_idx"] for s in "ab" if row[f"{s}_kind"] == 1]
        assert nearest(v, a + b, banned) == row["item_idx"]


def test_closures_are_reused_by_content(spark, tmp_path, monkeypatch):
    v, r = unit(RNG.standard_normal((12, 4))), frame(spark, unit(RNG.standard_normal((2, 4))), "seed_idx")
    first = craft.stored_closure(frame(spark, v, "item_idx"), r, str(tmp_path))
    runs = []
    monkeypatch.setattr(craft, "reach_closure", lambda *a: runs.append(a) or first)
    again = craft.stored_closure(frame(spark, v, "item_idx").repartition(3), r, str(tmp_path))
    assert not runs and (again.total, again.reached) == (first.total, first.reached)
    assert sorted(map(str, again.recipes.collect())) == sorted(map(str, first.recipes.collect()))
    craft.stored_closure(frame(spark, v + 0.01, "item_idx"), r, str(tmp_path))
    assert len(runs) == 1


def test_projection_plan_end_to_end(spark):
    m = RNG.standard_normal((60, 8))
    vectors = frame(spark, m, "item_id").withColumn("item_id", F.col("item_id").cast("string"))
    anchors = spark.createDataFrame([(i, f"a{i}", "g" if i < 4 else "h", [float(x) for x in v]) for i, v in enumerate(RNG.standard_normal((7, 8)))],
                                    "anchor_idx long, name string, group_key string, v array<double>")
    groups = spark.createDataFrame([(0, "g", "g", "G", "#111111"), (1, "h", "h", "H", "#222222"), (2, "x", "x", "X", "#333333")],
                                   "group_idx int, group_key string, key string, label string, color string")
    features = spark.createDataFrame([("0", "Zero", 3, 1, 0, 4, "film", 0.12345, "d" * 300)],
                                     "item_id string, name string, n_film long, n_tv long, n_lit long, n_total long, "
                                     "dominant_media string, gender_ratio double, description string")
    made = project.project(vectors, features, anchors, groups, neighbors=4, clusters=5, model="m")
    rows = {r["id"]: r for r in made.points.collect()}
    assert len(rows) == 60
    first = rows["0"]
    assert (first["name"], first["nf"], first["tot"], first["g"], len(first["d"])) == ("Zero", 3, 4, 0.123, 241)
    assert rows["1"]["tot"] == 0 and rows["1"]["g"] is None and rows["1"]["d"] == ""
    assert all(len(r["nn"]) == 4 and r["i"] not in r["nn"] and len(r["g3"]) == 3 and r["gen"] == r["g3"][0] for r in rows.values())
    assert all(len(r["sa"]) == 3 and r["sa"][2] == 0 for r in rows.values())
    for axes in (("x", "y"), ("x3", "y3", "z3")):
        assert max(abs(r[a]) for r in rows.values() for a in axes) == pytest.approx(1, abs=1e-4)
    assert {r["c"] for r in rows.values()} <= set(range(5))
    meta = made.meta.first()
    assert (meta["n"], meta["clusters"], meta["anchors"][0], meta["groups"][1]["label"]) == (60, 5, "a0", "H")
