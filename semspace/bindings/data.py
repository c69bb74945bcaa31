"""The engine's inputs, derived from the standard test tables, and the same as SQL.

items      every embedding                      anchors  mean vector of each (label, quadrant)
words      mean vector of each label            seeds    mean vector of each quadrant
groups     the nations (label = nation key)     catalogue  part
occurrences  film = lineitem by supplier, tv = orders by customer, lit = events by user
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize_eps
from ..operators.clean import dense_index
from ..operators.compose import craft_universe
from ..sources.storage import materialize
from ..sources.tables import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("v"), "label")


def mean_vectors(spark: SparkSession, sf: str, *keys: str) -> DataFrame:
    """Mean vector per key; keys are label, p and q (signs of the first two components). Written
    once, as every use reads it several times."""
    cells = table(spark, sf, "embeddings").select(
        "label", (F.element_at("embedding", 1) > 0).cast("int").alias("p"),
        (F.element_at("embedding", 2) > 0).cast("int").alias("q"),
        F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    means = cells.groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "x")))
    return materialize(means.groupBy(*keys).agg(F.transform(ordered, lambda c: c["x"]).alias("v")), "means")


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    cells = dense_index(mean_vectors(spark, sf, "label", "p", "q"), ["label", "p", "q"], "anchor_idx")
    name = F.concat_ws("_", F.lit("anchor"), "label", "p", "q")
    return cells.select("anchor_idx", name.alias("name"), F.col("label").alias("group_key"), "v")


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("group_idx"), F.col("n_nationkey").alias("group_key"),
        F.col("n_name").alias("key"), F.col("n_name").alias("label"),
        F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("n_nationkey") * 10000)), 6, "0")).alias("color"))


def seeds(spark: SparkSession, sf: str) -> DataFrame:
    return mean_vectors(spark, sf, "p", "q").select(
        (F.col("p") * 2 + F.col("q")).cast("long").alias("seed_idx"),
        F.concat_ws("_", F.lit("seed"), "p", "q").alias("name"), l2_normalize_eps(F.col("v")).alias("v"))


def universe(spark: SparkSession, sf: str) -> DataFrame:
    """words ++ anchors ++ items, unit vectors."""
    words = mean_vectors(spark, sf, "label").select(
        F.col("label").cast("long").alias("ord"), F.concat_ws("_", F.lit("word"), "label").alias("name"), "v")
    anchor = anchors(spark, sf).select(F.col("anchor_idx").alias("ord"), "name", "v")
    item = items(spark, sf).select(F.col("idx").alias("ord"), F.concat_ws("_", F.lit("item"), "idx").alias("name"),
                                   F.col("v").cast("array<double>").alias("v"))
    whole = craft_universe(("word", words), ("genre", anchor), ("item", item))
    return materialize(whole.select("item_idx", "kind", "name", l2_normalize_eps(F.col("v")).alias("v")), "universe")


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("description"), F.col("p_partkey").alias("ord"))


def events(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    def ids(name: str, column: str) -> DataFrame:
        return table(spark, sf, name).select(F.col(column).alias("item_id"))

    return {"film": ids("lineitem", "l_suppkey"), "tv": ids("orders", "o_custkey"),
            "lit": ids("events", "user_id")}


def scores(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("p_size") > 10, F.col("p_retailprice").cast("string")).otherwise(F.col("p_brand"))
    return table(spark, sf, "part").select(F.col("p_name").alias("name"), text.alias("score"),
                                           F.col("p_partkey").alias("ord"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def found_items(spark: SparkSession, sf: str) -> DataFrame:
    """What each user discovered: (user_id, item_idx, kind, name), each once."""
    found = table(spark, sf, "events").select(
        "user_id", F.floor("value").cast("long").alias("item_idx"), "event_type")
    kind = F.when(F.col("item_idx") < 10, "word").when(F.col("item_idx") < 50, "genre").otherwise("item")
    return found.withColumn("kind", kind).withColumn("name", F.concat_ws("_", "kind", "item_idx"))


def exploded(df: DataFrame, key: str, vec: str | Column, value: str = "x") -> DataFrame:
    column = F.col(vec) if isinstance(vec, str) else vec
    return df.select(key, F.posexplode(column).alias("pos", "_x")).select(
        key, "pos", F.round(F.col("_x").cast("double"), 6).alias(value))


# -- the same as SQL ----------------------------------------------------------------------------

def unit(v: str) -> str:
    return f"[y / (sqrt(list_dot_product({v}, {v})) + 1e-9) for y in {v}]"


CELLS = """
cells AS (SELECT label, CAST(embedding[1] > 0 AS INT) AS p, CAST(embedding[2] > 0 AS INT) AS q,
                 unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos
          FROM embeddings)"""

ITEMS = "items AS (SELECT vec_id AS item_id, vec_id AS idx, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"

ANCHORS = f"""{CELLS},
anchor_cells AS (SELECT label, p, q, pos, avg(x) AS x FROM cells GROUP BY ALL),
anchors AS (SELECT row_number() OVER (ORDER BY label, p, q) - 1 AS anchor_idx,
                   'anchor_' || label || '_' || p || '_' || q AS name, label AS group_key, v
            FROM (SELECT label, p, q, list(x ORDER BY pos) AS v FROM anchor_cells GROUP BY ALL))"""

AFFINITY = f"""{ITEMS},{ANCHORS},
iu AS (SELECT item_id, {unit("v")} AS v FROM items),
au AS (SELECT anchor_idx, group_key, name, {unit("v")} AS v FROM anchors),
aff AS (SELECT item_id, anchor_idx, group_key, name, list_dot_product(iu.v, au.v) AS a FROM iu, au),
stats AS (SELECT anchor_idx, avg(a) AS mean, stddev_pop(a) AS std, min(a) AS lo, max(a) AS hi
          FROM aff GROUP BY anchor_idx),
zs AS (SELECT item_id, anchor_idx, group_key, name, (a - mean) / (std + 1e-6) AS z
       FROM aff JOIN stats USING (anchor_idx)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(z, 9) DESC, anchor_idx) AS rank
           FROM zs)"""

GROUPS = """
ids AS (SELECT item_id FROM items),
sa AS (SELECT i.item_id, n.n_nationkey AS group_idx, coalesce(g.s, 0) AS s
       FROM ids i CROSS JOIN nation n
       LEFT JOIN (SELECT item_id, group_key, avg(z) AS s FROM zs GROUP BY ALL) g
         ON g.item_id = i.item_id AND g.group_key = n.n_nationkey),
sa_range AS (SELECT group_idx, min(s) AS lo, max(s) AS hi FROM sa GROUP BY ALL)"""

UNIVERSE = f"""{ITEMS},{ANCHORS},
word_cells AS (SELECT label, pos, avg(x) AS x FROM cells GROUP BY ALL),
words AS (SELECT label, list(x ORDER BY pos) AS v FROM word_cells GROUP BY ALL),
stacked AS (SELECT 0 AS kind_ord, 'word' AS kind, label AS ord, 'word_' || label AS name, v FROM words
            UNION ALL SELECT 1, 'genre', anchor_idx, name, v FROM anchors
            UNION ALL SELECT 2, 'item', idx, 'item_' || idx, v FROM items),
u AS (SELECT row_number() OVER (ORDER BY kind_ord, ord) - 1 AS item_idx, kind, name, {unit("v")} AS v
      FROM stacked),
seed_cells AS (SELECT p, q, pos, avg(x) AS x FROM cells GROUP BY ALL),
seed_raw AS (SELECT p * 2 + q AS seed_idx, 'seed_' || p || '_' || q AS name, list(x ORDER BY pos) AS v
             FROM seed_cells GROUP BY p, q),
seeds AS (SELECT seed_idx, name, {unit("v")} AS v FROM seed_raw)"""


def vec_sum(a: str, b: str) -> str:
    return f"[{a}[i] + {b}[i] for i in range(1, len({a}) + 1)]"


SEED_ROUND = f"""{UNIVERSE},
seed_sums AS (SELECT a.seed_idx AS ai, b.seed_idx AS bi, {vec_sum("a.v", "b.v")} AS v
              FROM seeds a JOIN seeds b ON a.seed_idx <= b.seed_idx),
seed_unit AS (SELECT ai, bi, {unit("v")} AS v FROM seed_sums),
seed_best AS (SELECT ai, bi, item_idx FROM (
                SELECT ai, bi, item_idx, row_number() OVER (
                  PARTITION BY ai, bi ORDER BY round(list_dot_product(s.v, u.v), 9) DESC, item_idx) AS r
                FROM seed_unit s, u) WHERE r = 1),
seed_hits AS (SELECT item_idx, ai AS a_idx, bi AS b_idx FROM (
                SELECT *, row_number() OVER (PARTITION BY item_idx ORDER BY ai, bi) AS r FROM seed_best)
              WHERE r = 1)"""

EXPANSION = f"""{SEED_ROUND},
frontier AS (SELECT item_idx, row_number() OVER (ORDER BY a_idx, b_idx) - 1 AS pos FROM seed_hits),
sums AS (SELECT f.item_idx AS a_idx, f.pos, s.seed_idx AS b_idx, {vec_sum("fu.v", "s.v")} AS v
         FROM frontier f JOIN u fu USING (item_idx), seeds s),
sums_unit AS (SELECT a_idx, pos, b_idx, {unit("v")} AS v FROM sums),
best AS (SELECT a_idx, pos, b_idx, item_idx FROM (
           SELECT a_idx, pos, b_idx, u.item_idx, row_number() OVER (
             PARTITION BY pos, b_idx ORDER BY round(list_dot_product(s.v, u.v), 9) DESC, u.item_idx) AS r
           FROM sums_unit s JOIN u ON u.item_idx <> s.a_idx) WHERE r = 1),
hits AS (SELECT item_idx, a_idx, b_idx FROM (
           SELECT *, row_number() OVER (PARTITION BY item_idx ORDER BY b_idx, pos) AS r FROM best
           WHERE item_idx NOT IN (SELECT item_idx FROM seed_hits)) WHERE r = 1),
recipes AS (SELECT item_idx, 0 AS a_kind, a_idx, 0 AS b_kind, b_idx FROM seed_hits
            UNION ALL SELECT item_idx, 1, a_idx, 0, b_idx FROM hits)"""

FEATURES = """
occ AS (SELECT CAST(l_suppkey AS VARCHAR) AS item_id, 'film' AS medium FROM lineitem
        UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'tv' FROM orders
        UNION ALL SELECT CAST(user_id AS VARCHAR), 'lit' FROM events),
n AS (SELECT item_id, count(*) FILTER (medium = 'film') AS n_film, count(*) FILTER (medium = 'tv') AS n_tv,
             count(*) FILTER (medium = 'lit') AS n_lit FROM occ GROUP BY item_id),
counted AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS name, p_type AS description,
                   coalesce(n_film, 0) AS n_film, coalesce(n_tv, 0) AS n_tv, coalesce(n_lit, 0) AS n_lit,
                   coalesce(n_film, 0) + coalesce(n_tv, 0) + coalesce(n_lit, 0) AS n_total
            FROM part LEFT JOIN n ON n.item_id = CAST(p_partkey AS VARCHAR)),
mixed AS (SELECT *,
            CASE WHEN n_total > 0 THEN round_even(n_film::DOUBLE / n_total, 3) ELSE 0.0::DOUBLE END AS frac_film,
            CASE WHEN n_total > 0 THEN round_even(n_tv::DOUBLE / n_total, 3) ELSE 0.0::DOUBLE END AS frac_tv,
            CASE WHEN n_total > 0 THEN round_even(n_lit::DOUBLE / n_total, 3) ELSE 0.0::DOUBLE END AS frac_lit,
            CASE WHEN n_total = 0 THEN 'unused' WHEN n_film >= n_tv AND n_film >= n_lit THEN 'film'
                 WHEN n_tv >= n_lit THEN 'tv' ELSE 'lit' END AS dominant_media FROM counted),
first_score AS (SELECT name, score FROM (
                  SELECT p_name AS name, p_retailprice AS score,
                         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r
                  FROM part WHERE p_size > 10) WHERE r = 1),
features AS (SELECT mixed.*, score AS gender_ratio FROM mixed LEFT JOIN first_score USING (name))"""

FOUND = """
found AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS item_idx, event_type,
                 CASE WHEN floor(value) < 10 THEN 'word' WHEN floor(value) < 50 THEN 'genre' ELSE 'item' END AS kind
          FROM events)"""
