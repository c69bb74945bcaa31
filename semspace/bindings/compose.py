"""Composition, closure, points and the interactive reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import palette_slot
from ..operators import compose as M
from ..operators import explore as X
from ..operators.nearest import NearestIndex, knn_graph
from ..operators.points import assemble_points as assemble
from ..operators.points import points_meta
from ..plans.project import affinity_profile, project
from ..sources.storage import materialize, scratch_path
from ..sources.tables import read_points_json, write_points_json
from . import data as D
from .features import features
from .registry import register
from .vectors import KNN, zscores


def index_of(universe, copies=3):
    return NearestIndex(universe.select(F.col("item_idx").alias("idx"), "v"), copies_kept=copies)


@register(f"WITH {D.UNIVERSE} SELECT item_idx, kind, name FROM u")
def craft_universe(spark, sf):
    return D.universe(spark, sf).select("item_idx", "kind", "name")


# every item with the word of its label
@register(f"""WITH {D.UNIVERSE},
              pairs AS (SELECT vec_id AS pair_id, i.item_idx AS a, i.v AS av, w.item_idx AS b, w.v AS bv
                        FROM embeddings JOIN u i ON i.name = 'item_' || vec_id JOIN u w ON w.name = 'word_' || label),
              sums AS (SELECT pair_id, a, b, {D.vec_sum("av", "bv")} AS v FROM pairs),
              su AS (SELECT pair_id, a, b, {D.unit("v")} AS v FROM sums)
              SELECT pair_id, item_idx AS result_idx FROM (
                SELECT pair_id, item_idx, row_number() OVER (PARTITION BY pair_id
                  ORDER BY round(list_dot_product(su.v, u.v), 9) DESC, item_idx) AS r
                FROM su JOIN u ON item_idx <> a AND item_idx <> b) WHERE r = 1""")
def combine_pairs(spark, sf):
    whole = D.universe(spark, sf)
    keys = whole.select("name", M.element_key(F.lit(1), F.col("item_idx")).alias("key"))
    asked = D.items(spark, sf).select(
        F.col("item_id").alias("pair_id"), F.concat_ws("_", F.lit("item"), "item_id").alias("item"),
        F.concat_ws("_", F.lit("word"), "label").alias("word"))
    pairs = (asked.join(keys.toDF("item", "a_key"), "item").join(keys.toDF("word", "b_key"), "word"))
    known = M.elements(D.seeds(spark, sf), whole)
    return M.combine_pairs(pairs, known, index_of(whole)).select("pair_id", "result_idx")


# requests: (user, value) of every event; answered already: those of 'view' events
@register(f"""WITH {D.UNIVERSE},
              req AS (SELECT user_id AS x, CAST(floor(value) AS BIGINT) AS y, event_type FROM events),
              keyed AS (SELECT x, y, event_type, array_to_string(list_sort(['i' || x, 'i' || y]), '+') AS pair_id
                        FROM req),
              want AS (SELECT pair_id, min(x) AS x, min(y) AS y FROM (
                         SELECT pair_id, least(x, y) AS x, greatest(x, y) AS y FROM keyed)
                       WHERE pair_id NOT IN (SELECT pair_id FROM keyed WHERE event_type = 'view') GROUP BY pair_id),
              sums AS (SELECT pair_id, x, y, {D.vec_sum("a.v", "b.v")} AS v
                       FROM want JOIN u a ON a.item_idx = x JOIN u b ON b.item_idx = y),
              su AS (SELECT pair_id, x, y, {D.unit("v")} AS v FROM sums)
              SELECT pair_id, item_idx AS result_idx FROM (
                SELECT pair_id, item_idx, row_number() OVER (PARTITION BY pair_id
                  ORDER BY round(list_dot_product(su.v, u.v), 9) DESC, item_idx) AS r
                FROM su JOIN u ON item_idx <> x AND item_idx <> y) WHERE r = 1""")
def combine_memo(spark, sf):
    whole = D.universe(spark, sf)
    asked = D.table(spark, sf, "events").select(
        "event_type", F.concat(F.lit("i"), F.col("user_id").cast("string")).alias("a_key"),
        F.concat(F.lit("i"), F.floor("value").cast("string")).alias("b_key"))
    memo = asked.where(F.col("event_type") == "view").select(
        M.pair_key(F.col("a_key"), F.col("b_key")).alias("pair_id")).distinct()
    known = M.elements(D.seeds(spark, sf), whole)
    return M.combine_memo(asked, memo, known, index_of(whole)).select("pair_id", "result_idx")


@register(f"WITH {D.SEED_ROUND} SELECT item_idx, a_idx, b_idx FROM seed_hits")
def seed_recipes(spark, sf):
    found = M.seed_recipes(D.seeds(spark, sf), index_of(D.universe(spark, sf)))
    return found.select("item_idx", "a_idx", "b_idx")


def first_rounds(spark, sf):
    """(universe, seed round, first expansion)."""
    whole, start = D.universe(spark, sf), D.seeds(spark, sf)
    index = index_of(whole)
    seed_round = materialize(M.seed_recipes(start, index), "round")
    frontier = M.dense_index(seed_round, ["key"], "pos")
    second = M.expand_round(frontier, M.Anchors.of_seeds(start), whole, seed_round, index)
    return whole, seed_round, materialize(second, "round")


@register(f"WITH {D.EXPANSION} SELECT item_idx, a_idx, b_idx FROM hits")
def expand_round(spark, sf):
    return first_rounds(spark, sf)[2].select("item_idx", "a_idx", "b_idx")


@register(f"""WITH {D.EXPANSION},
              un AS (SELECT item_idx, v FROM u WHERE item_idx NOT IN (SELECT item_idx FROM recipes)),
              re AS (SELECT item_idx, v FROM u WHERE item_idx IN (SELECT item_idx FROM recipes))
              SELECT DISTINCT item_idx FROM (
                SELECT re.item_idx, row_number() OVER (PARTITION BY un.item_idx
                  ORDER BY round(list_dot_product(un.v, re.v), 9) DESC, re.item_idx) AS r FROM un, re) WHERE r = 1""")
def hub_candidates(spark, sf):
    whole, one, two = first_rounds(spark, sf)
    return M.hub_candidates(whole, one.select("item_idx").unionByName(two.select("item_idx"))).select("item_idx")


@register(f"""WITH {D.EXPANSION} SELECT kind, count(*) AS items, round(avg(CASE WHEN r.item_idx IS NULL THEN 0 ELSE 1 END),
              6) AS coverage FROM u LEFT JOIN recipes r USING (item_idx) GROUP BY ROLLUP (kind)""")
def coverage_by_kind(spark, sf):
    whole, one, two = first_rounds(spark, sf)
    reached = one.select("item_idx").unionByName(two.select("item_idx"))
    return M.coverage_by_kind(whole, reached).withColumn("coverage", F.round("coverage", 6))


@register()
def reach_closure(spark, sf):
    return M.reach_closure(D.universe(spark, sf), D.seeds(spark, sf)).recipes


# with the seeds as the only anchors an item leads to one item per seed
@register(f"""WITH RECURSIVE {D.SEED_ROUND},
              moves AS (SELECT f.item_idx AS a_idx, s.seed_idx AS b_idx, {D.vec_sum("f.v", "s.v")} AS v FROM u f, seeds s),
              mu AS (SELECT a_idx, b_idx, {D.unit("v")} AS v FROM moves),
              step AS (SELECT a_idx, item_idx FROM (
                         SELECT a_idx, b_idx, u.item_idx, row_number() OVER (PARTITION BY a_idx, b_idx
                           ORDER BY round(list_dot_product(mu.v, u.v), 9) DESC, u.item_idx) AS r
                         FROM mu JOIN u ON u.item_idx <> a_idx) WHERE r = 1),
              r AS (SELECT item_idx FROM seed_hits UNION SELECT step.item_idx FROM r JOIN step ON step.a_idx = r.item_idx)
              SELECT u.item_idx, r.item_idx IS NOT NULL AS reached FROM u LEFT JOIN r ON r.item_idx = u.item_idx""")
def reach_by_seeds(spark, sf):
    done = M.reach_closure(D.universe(spark, sf), D.seeds(spark, sf), hub_step=0)
    return done.recipes.select("item_idx", F.col("a_kind").isNotNull().alias("reached"))


# every item of these tables can be reached, from parents of an earlier round, and its recipe gives it again
@register(f"WITH {D.UNIVERSE} SELECT item_idx, item_idx AS result_idx, true AS parents_earlier FROM u")
def closure_replay(spark, sf):
    whole, start = D.universe(spark, sf), D.seeds(spark, sf)
    recipes = materialize(M.reach_closure(whole, start).recipes, "recipes")
    pairs = recipes.select(F.col("item_idx").alias("pair_id"), *[
        M.element_key(F.col(f"{s}_kind"), F.col(f"{s}_idx")).alias(f"{s}_key") for s in "ab"])
    found = M.combine_pairs(pairs, M.elements(start, whole), index_of(whole))
    timed = recipes.select("item_idx", "round", *[F.when(F.col(f"{s}_kind") == M.ITEM, F.col(f"{s}_idx")).alias(s) for s in "ab"])
    for s in "ab":
        before = recipes.select(F.col("item_idx").alias(s), F.col("round").alias(f"{s}_round"))
        timed = timed.join(before, s, "left")
    earlier = [F.col(s).isNull() | F.coalesce(F.col(f"{s}_round") < F.col("round"), F.lit(False)) for s in "ab"]
    timed = timed.select("item_idx", (earlier[0] & earlier[1]).alias("parents_earlier"))
    return found.select(F.col("pair_id").alias("item_idx"), "result_idx").join(timed, "item_idx")


@register(f"""WITH {D.FOUND} SELECT DISTINCT user_id, item_idx FROM found f WHERE NOT EXISTS (
                SELECT 1 FROM found o WHERE o.event_type = 'view' AND o.user_id = f.user_id AND o.item_idx = f.item_idx)""")
def new_discoveries(spark, sf):
    found = D.found_items(spark, sf)
    return M.new_discoveries(found, found.where(F.col("event_type") == "view"))


@register(f"""WITH {D.EXPANSION}, {D.FOUND}, asked AS (SELECT DISTINCT user_id, item_idx FROM found),
              own AS (SELECT DISTINCT user_id, item_idx FROM found WHERE event_type = 'view'),
              r AS (SELECT user_id, item_idx, CASE a_kind WHEN 0 THEN 'r' ELSE 'i' END || a_idx AS a_key, a_kind, a_idx,
                           CASE b_kind WHEN 0 THEN 'r' ELSE 'i' END || b_idx AS b_key, b_kind, b_idx
                    FROM asked LEFT JOIN recipes USING (item_idx))
              SELECT r.user_id, r.item_idx, a_key, CASE a_kind WHEN 0 THEN sa_.name ELSE ua.name END AS a_name,
                     CASE WHEN a_key IS NOT NULL THEN a_kind = 0 OR oa.item_idx IS NOT NULL END AS a_have,
                     b_key, sb.name AS b_name, CASE WHEN b_key IS NOT NULL THEN true END AS b_have
              FROM r LEFT JOIN u ua ON a_kind = 1 AND ua.item_idx = a_idx
                     LEFT JOIN seeds sa_ ON a_kind = 0 AND sa_.seed_idx = a_idx
                     LEFT JOIN seeds sb ON sb.seed_idx = b_idx
                     LEFT JOIN own oa ON a_kind = 1 AND oa.user_id = r.user_id AND oa.item_idx = a_idx""")
def recipe_lookup(spark, sf):
    whole, one, two = first_rounds(spark, sf)
    found = D.found_items(spark, sf)
    names = (whole.select(M.element_key(F.lit(1), F.col("item_idx")).alias("key"), "name").unionByName(
        D.seeds(spark, sf).select(M.element_key(F.lit(0), F.col("seed_idx")).alias("key"), "name")))
    return X.recipe_lookup(found.select("user_id", "item_idx").distinct(), one.unionByName(two), names,
                           found.where(F.col("event_type") == "view"))


@register(f"""WITH {D.FOUND}, once AS (SELECT DISTINCT user_id, item_idx, kind FROM found)
              SELECT user_id, count(*) AS items, count(*) FILTER (kind = 'genre') AS of_kind FROM once GROUP BY user_id""")
def discovery_progress(spark, sf):
    return X.discovery_progress(D.found_items(spark, sf))


@register(f"""WITH {D.FOUND}, once AS (SELECT DISTINCT user_id, item_idx, kind, kind || '_' || item_idx AS name FROM found)
              SELECT user_id, kind, item_idx, name, CAST(rank AS INT) AS rank, section_size FROM (
                SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY name, item_idx) AS rank,
                       count(*) OVER (PARTITION BY user_id, kind) AS section_size FROM once) WHERE rank <= 400""")
def palette_sections(spark, sf):
    found = D.found_items(spark, sf).select("user_id", "kind", "item_idx", "name").distinct()
    return X.palette_sections(found).select("user_id", "kind", "item_idx", "name", "rank", "section_size")


@register(f"""WITH {D.UNIVERSE},{D.FOUND}, once AS (SELECT DISTINCT user_id, item_idx, kind, kind || '_' || item_idx AS name FROM found),
              hit AS (SELECT user_id, kind, item_idx, name FROM once WHERE contains(lower(name), '1')
                      UNION ALL SELECT user_id, 'root', seed_idx, name FROM (SELECT DISTINCT user_id FROM once), seeds
                      WHERE contains(lower(name), '1'))
              SELECT user_id, kind, item_idx, name, CAST(rank AS INT) AS rank, section_size FROM (
                SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY CASE WHEN kind <> 'root' THEN name END, item_idx) AS rank,
                       count(*) OVER (PARTITION BY user_id, kind) AS section_size FROM hit) WHERE rank <= 400 OR kind = 'root'""")
def palette_with_roots(spark, sf):
    """All sections for a query, the roots among them."""
    found = D.found_items(spark, sf).select("user_id", "kind", "item_idx", "name").distinct()
    return X.palette_sections(found, "1", roots=D.seeds(spark, sf)).select(
        "user_id", "kind", "item_idx", "name", "rank", "section_size")


# -- points -------------------------------------------------------------------------------------

POINTS_SQL = f"""WITH {D.AFFINITY},{D.GROUPS},{D.FEATURES},
nb AS (SELECT a.item_id AS src, b.item_id AS dst, row_number() OVER (
         PARTITION BY a.item_id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.item_id) AS rank
       FROM iu a JOIN iu b ON a.item_id <> b.item_id),
nn AS (SELECT src AS item_id, string_agg(CAST(dst AS VARCHAR), '|' ORDER BY rank) AS nn FROM nb WHERE rank <= 10 GROUP BY src),
g3 AS (SELECT item_id, string_agg(name, '|' ORDER BY rank) AS g3, min(name) FILTER (rank = 1) AS gen
       FROM ranked WHERE rank <= 3 GROUP BY item_id),
sg AS (SELECT item_id, group_idx FROM (SELECT *, row_number() OVER (
         PARTITION BY item_id ORDER BY round(s, 9) DESC, group_idx) AS r FROM sa) WHERE r = 1),
sa01 AS (SELECT item_id, string_agg(CAST(CAST(round_even((s - lo) / (hi - lo + 1e-6), 3) * 1000 AS INT) AS VARCHAR), '|'
           ORDER BY group_idx) AS sa FROM sa JOIN sa_range USING (group_idx) GROUP BY item_id)
SELECT e.vec_id AS i, CAST(e.vec_id AS VARCHAR) AS id, f.name,
       round_even(CAST(embedding[1] AS DOUBLE), 4) AS x, round_even(CAST(embedding[2] AS DOUBLE), 4) AS y,
       round_even(CAST(embedding[1] AS DOUBLE), 4) AS x3, round_even(CAST(embedding[2] AS DOUBLE), 4) AS y3,
       round_even(CAST(embedding[3] AS DOUBLE), 4) AS z3, e.label AS c, CAST(sg.group_idx AS INT) AS sg, gen, g3, sa,
       f.dominant_media AS media, coalesce(n_film, 0) AS nf, coalesce(n_tv, 0) AS nt, coalesce(n_lit, 0) AS nl,
       coalesce(n_total, 0) AS tot, round_even(gender_ratio, 3) AS g, coalesce(description, '') AS d, nn
FROM embeddings e LEFT JOIN features f ON f.item_id = CAST(e.vec_id AS VARCHAR)
JOIN g3 ON g3.item_id = e.vec_id JOIN sg ON sg.item_id = e.vec_id JOIN sa01 ON sa01.item_id = e.vec_id
JOIN nn ON nn.item_id = e.vec_id"""


def points(spark, sf):
    """All embeddings as points: layout from the first components, cluster = label."""
    items = D.items(spark, sf)
    profile = affinity_profile(materialize(zscores(spark, sf), "z"), D.anchors(spark, sf), D.groups(spark, sf))
    edges = knn_graph(items, 10).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("e"))
    nn = edges.select(F.col("src").alias("item_id"), F.transform("e", lambda e: e["dst"]).alias("nn"))
    described = features(spark, sf).withColumn("item_id", F.col("item_id").cast("long"))
    axes = {"x": 1, "y": 2, "x3": 1, "y3": 2, "z3": 3}
    placed = items.select("item_id", F.col("idx").alias("i"), F.col("label").alias("cluster"),
                          *[F.element_at("v", at).cast("double").alias(c) for c, at in axes.items()])
    whole = placed.join(described, "item_id", "left").join(profile, "item_id").join(nn, "item_id")
    return assemble(whole)


def flat(df):
    return df.withColumns({
        "g3": F.array_join("g3", "|"), "nn": F.array_join(F.col("nn").cast("array<string>"), "|"),
        "sa": F.array_join(F.transform("sa", lambda s: F.rint(s * 1000).cast("int").cast("string")), "|")})


@register(POINTS_SQL)
def assemble_points(spark, sf):
    return flat(points(spark, sf))


@register(POINTS_SQL)
def points_json(spark, sf):
    """The same after a round trip through the JSON sink."""
    rows = points(spark, sf)
    meta = points_meta(0, "given", "components", 10, D.groups(spark, sf), D.anchors(spark, sf))
    path = scratch_path(spark, "points")
    write_points_json(rows, meta, path)
    return flat(read_points_json(spark, path, rows.schema))


PLAN_SQL = f"""SELECT i, id, name, sg, gen, g3, sa, media, nf, nt, nl, tot, g, d, nn FROM ({POINTS_SQL})"""


@register(PLAN_SQL)
def project_points(spark, sf):
    """The whole projection plan over all embeddings; the columns that SQL can say (layout and clusters are
    iterative)."""
    items = D.items(spark, sf)
    made = project(items.select("item_id", "v"), features(spark, sf).withColumn("item_id", F.col("item_id").cast("long")),
                   D.anchors(spark, sf), D.groups(spark, sf))
    return flat(made.points).select("i", "id", "name", "sg", "gen", "g3", "sa", "media", "nf", "nt", "nl", "tot", "g", "d", "nn")


# points over the parts: media = return flags of their line items, popularity = number of them
PART_POINTS = """
counts AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'A') AS nf, count(*) FILTER (l_returnflag = 'N') AS nt,
                  count(*) FILTER (l_returnflag = 'R') AS nl, count(*) AS tot FROM lineitem GROUP BY 1),
pts AS (SELECT p_partkey AS i, p_name AS name, p_size AS c, coalesce(nf, 0) AS nf, coalesce(nt, 0) AS nt,
               coalesce(nl, 0) AS nl, coalesce(tot, 0) AS tot, p_retailprice / 1000 AS x3, p_size / 50.0::DOUBLE AS y3,
               p_retailprice / 5000 AS z3, CASE WHEN p_size > 25 THEN p_size / 50.0::DOUBLE END AS g
        FROM part LEFT JOIN counts ON l_partkey = p_partkey),
mx AS (SELECT max(tot) AS m FROM pts)"""


def part_points(spark, sf):
    counts = D.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("i")).agg(
        *[F.count_if(F.col("l_returnflag") == flag).alias(n) for flag, n in (("A", "nf"), ("N", "nt"), ("R", "nl"))],
        F.count("*").alias("tot"))
    size = F.col("p_size") / F.lit(50.0)
    parts = D.table(spark, sf, "part").select(
        F.col("p_partkey").alias("i"), F.col("p_name").alias("name"), F.col("p_size").alias("c"),
        (F.col("p_retailprice") / 1000).alias("x3"), size.alias("y3"), (F.col("p_retailprice") / 5000).alias("z3"),
        F.when(F.col("p_size") > 25, size).alias("g"))
    return parts.join(counts, "i", "left").fillna(0, ["nf", "nt", "nl", "tot"])


@register(f"""WITH {PART_POINTS}, hits AS (SELECT i, name, tot FROM pts WHERE contains(lower(name), 'ring') ORDER BY i LIMIT 40)
              SELECT i, name, tot FROM hits ORDER BY tot DESC, i LIMIT 30""")
def search_items(spark, sf):
    return X.search_items(part_points(spark, sf), " Ring ").select("i", "name", "tot")


@register("""SELECT p_partkey AS item_idx, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') AND p_partkey NOT IN (
               SELECT CAST(floor(value) AS BIGINT) FROM events) ORDER BY 1 LIMIT 8""")
def undiscovered_search(spark, sf):
    parts = D.table(spark, sf, "part").select(F.col("p_partkey").alias("item_idx"), F.col("p_name").alias("name"))
    return X.undiscovered_search(parts, D.found_items(spark, sf), "ring")


@register("""SELECT p_partkey, coalesce(n_name, '') AS label,
             coalesce('#' || lpad(lower(to_hex(n_nationkey * 10000)), 6, '0'), '#9aa0b8') AS color, p_size % 24 AS slot
             FROM part LEFT JOIN nation ON n_nationkey = p_size""")
def dimension_lookup(spark, sf):
    parts = D.table(spark, sf, "part").select("p_partkey", F.col("p_size").alias("group_key"))
    named = X.dimension_lookup(parts, D.groups(spark, sf), "group_key")
    return named.select("p_partkey", "label", "color", palette_slot(F.col("group_key")).alias("slot"))


EDGE_SQL = f"""WITH {KNN}, pts AS (SELECT vec_id AS i, 'Item' || vec_id || 'OfLabel' || label AS name,
                                       round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y
                                FROM embeddings)
SELECT src, CAST(rank AS INT) AS rank, dst, a.x AS src_x, a.y AS src_y, regexp_replace(regexp_replace(b.name,
         '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') AS dst_name,
       b.x AS dst_x, b.y AS dst_y, '{X.ITEM_URL}' || b.name AS dst_url
FROM knn JOIN pts a ON a.i = src JOIN pts b ON b.i = dst"""


@register(EDGE_SQL)
def neighbor_edges(spark, sf):
    items = D.items(spark, sf)
    nn = knn_graph(items, 10).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst"))).alias("e"))
    named = items.select(
        F.col("idx").alias("i"), F.concat(F.lit("Item"), "idx", F.lit("OfLabel"), "label").alias("name"),
        *[F.round(F.element_at("v", at).cast("double"), 6).alias(c) for c, at in (("x", 1), ("y", 2))])
    rows = named.join(nn.select(F.col("src").alias("i"), F.transform("e", lambda e: e["dst"]).alias("nn")), "i")
    return X.neighbor_edges(materialize(rows, "points"))


@register(f"""WITH {PART_POINTS} SELECT i, round(2.0 + 3.4 * ln(1 + tot) / ln(1 + m), 6) AS size_2d,
              round(1.5 + 3.2 * ln(1 + tot) / ln(1 + m), 6) AS size_3d, 2.6::DOUBLE AS size_flat FROM pts, mx""")
def popularity_size(spark, sf):
    sized = X.popularity_sizes(part_points(spark, sf))
    return sized.select("i", F.round("size_2d", 6).alias("size_2d"), F.round("size_3d", 6).alias("size_3d"), "size_flat")


@register(f"""WITH {PART_POINTS} SELECT i, round(x3, 6) AS map1, round(y3, 6) AS map2, round(z3, 6) AS map3,
              round(nf / greatest(nf + nt + nl, 1) * 2 - 1, 6) AS film, round(nt / greatest(nf + nt + nl, 1) * 2 - 1, 6) AS tv,
              round(nl / greatest(nf + nt + nl, 1) * 2 - 1, 6) AS lit, round(ln(1 + tot) / ln(1 + m) * 2 - 1, 6) AS pop,
              round(coalesce(g, 0), 6) AS score, round(c / 49.0::DOUBLE * 2 - 1, 6) AS cluster, 0.0::DOUBLE AS flat FROM pts, mx""")
def axis_metrics(spark, sf):
    metrics = X.axis_metrics(part_points(spark, sf), clusters=50)
    return metrics.select("i", *[F.round(c, 6).alias(c) for c in X.AXES])


@register(f"""WITH {PART_POINTS} SELECT i, round((ln(1 + tot) / ln(1 + m) * 2 - 1) * 60, 6) AS x,
              round(coalesce(g, 0) * 60, 6) AS y, round(z3 * 60, 6) AS z FROM pts, mx""")
def axis_remap(spark, sf):
    moved = X.axis_remap(X.axis_metrics(part_points(spark, sf)), "pop", "score", "no such metric")
    return moved.select("i", *[F.round(c, 6).alias(c) for c in "xyz"])
