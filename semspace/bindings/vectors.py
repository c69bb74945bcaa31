"""Vector functions, affinity, layout, clusters, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import affinity as A
from ..operators import cluster, reduce
from ..operators import nearest as N
from ..operators.text_features import lsa_embed
from ..plans.craft import global_scale as scale_of
from ..sources.storage import materialize
from ..sources.tables import vector_manifest as manifest
from . import data as D
from .registry import register
from .text import doc_terms

# label 0 gives zero vectors, the others lengths 1 to 9
SCALED = "scaled AS (SELECT vec_id, [x * label for x in CAST(embedding AS DOUBLE[])] AS v FROM embeddings)"


def scaled(spark, sf):
    return D.table(spark, sf, "embeddings").select(
        "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("label")).alias("v"))


def as_rows(sql_vector: str, source: str, key: str = "vec_id") -> str:
    return (f"SELECT {key}, pos - 1 AS pos, round(x, 6) AS x FROM (SELECT {key}, unnest({sql_vector}) AS x, "
            f"generate_subscripts({sql_vector}, 1) AS pos FROM {source})")


@register("SELECT count(*) AS n, max(len(embedding)) AS dim, 'given' AS model FROM embeddings")
def vector_manifest(spark, sf):
    vectors = D.items(spark, sf).withColumn("model", F.lit("given"))
    return manifest(vectors).withColumn("dim", F.col("dim").cast("long"))


@register(f"""WITH {SCALED}, n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM scaled),
              u AS (SELECT vec_id, CASE WHEN n > 0 THEN [x / n for x in v] ELSE v END AS v FROM n)
              {as_rows("v", "u")}""")
def l2_normalize(spark, sf):
    return D.exploded(scaled(spark, sf), "vec_id", V.l2_normalize(F.col("v")))


@register(f"WITH {SCALED}, u AS (SELECT vec_id, {D.unit('v')} AS v FROM scaled) {as_rows('v', 'u')}")
def l2_normalize_eps(spark, sf):
    return D.exploded(scaled(spark, sf), "vec_id", V.l2_normalize_eps(F.col("v")))


@register("""SELECT round(max(abs(x)), 6) AS scale FROM (
               SELECT unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)""")
def global_scale(spark, sf):
    return scale_of(D.items(spark, sf)).select(F.round("scale", 6).alias("scale"))


CODES = f"""{SCALED}, s AS (SELECT max(abs(x)) AS s FROM (SELECT unnest(v) AS x FROM scaled)),
codes AS (SELECT vec_id, s, [CAST(greatest(-127, least(127, round_even(x / s * 127, 0))) AS INT) for x in v] AS q
          FROM scaled, s)"""


def codes(spark, sf):
    vectors = scaled(spark, sf)
    with_scale = vectors.withColumn("s", scale_of(vectors).scalar())
    return with_scale.withColumn("q", V.quantize(F.col("v"), F.col("s")))


@register(f"""WITH {CODES} SELECT vec_id, pos - 1 AS pos, q FROM (
                SELECT vec_id, unnest(q) AS q, generate_subscripts(q, 1) AS pos FROM codes)""")
def quantize_int8(spark, sf):
    return codes(spark, sf).select("vec_id", F.posexplode("q").alias("pos", "q")).withColumn(
        "q", F.col("q").cast("int"))


@register(f"""WITH {CODES}, d AS (SELECT vec_id, [x * s / 127.0 for x in q] AS v FROM codes),
              u AS (SELECT vec_id, {D.unit('v')} AS v FROM d) {as_rows('v', 'u')}""")
def dequantize(spark, sf):
    return D.exploded(codes(spark, sf), "vec_id", V.dequantize(F.col("q"), F.col("s")))


@register("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y
                        FROM embeddings),
             m AS (SELECT avg(x) AS mx, avg(y) AS my FROM p),
             s AS (SELECT greatest(max(abs(x - mx)), max(abs(y - my))) AS s FROM p, m)
             SELECT vec_id, round((x - mx) / s, 6) AS x, round((y - my) / s, 6) AS y FROM p, m, s""")
def norm_coords(spark, sf):
    points = D.table(spark, sf, "embeddings").select(
        "vec_id", *[F.element_at("embedding", i).cast("double").alias(c) for i, c in ((1, "x"), (2, "y"))])
    return reduce.norm_coords(points, ["x", "y"]).select(
        "vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


# -- affinity -----------------------------------------------------------------------------------

def affinities(spark, sf):
    return A.affinity(D.items(spark, sf), D.anchors(spark, sf))


def zscores(spark, sf):
    return A.anchor_zscore(materialize(affinities(spark, sf), "affinity"))


def group_scores(spark, sf):
    groups, anchors = D.groups(spark, sf), D.anchors(spark, sf)
    return A.group_affinity(zscores(spark, sf), A.group_membership(anchors, groups), groups)


@register(f"WITH {D.AFFINITY} SELECT item_id, CAST(anchor_idx AS INT) AS anchor_idx, round(a, 6) AS a FROM aff")
def anchor_affinity(spark, sf):
    return A.long_form(affinities(spark, sf), "a", "anchor_idx", "a").withColumn("a", F.round("a", 6))


@register(f"""WITH {D.AFFINITY} SELECT CAST(anchor_idx AS INT) AS anchor_idx, round(mean, 6) AS mean,
              round(std, 6) AS std, round(lo, 6) AS lo, round(hi, 6) AS hi FROM stats""")
def anchor_stats(spark, sf):
    return A.anchor_stats(affinities(spark, sf)).select(
        "anchor_idx", *[F.round(c, 6).alias(c) for c in ("mean", "std", "lo", "hi")])


@register(f"WITH {D.AFFINITY} SELECT item_id, CAST(anchor_idx AS INT) AS anchor_idx, round(z, 6) AS z FROM zs")
def anchor_zscore(spark, sf):
    return A.long_form(zscores(spark, sf), "z", "anchor_idx", "z").withColumn("z", F.round("z", 6))


@register(f"WITH {D.AFFINITY} SELECT item_id, name AS anchor FROM ranked WHERE rank = 1")
def dominant_anchor(spark, sf):
    names = F.broadcast(D.anchors(spark, sf).select("anchor_idx", F.col("name").alias("anchor")))
    best = zscores(spark, sf).select("item_id", A.best_index(F.col("z")).cast("long").alias("anchor_idx"))
    return best.join(names, "anchor_idx").select("item_id", "anchor")


@register(f"""WITH {D.AFFINITY} SELECT item_id, CAST(rank AS INT) AS rank, CAST(anchor_idx AS INT) AS anchor_idx,
              round(z, 6) AS z FROM ranked WHERE rank <= 3""")
def top3_anchors(spark, sf):
    return A.top_anchors(zscores(spark, sf)).withColumn("z", F.round("z", 6))


@register(f"""WITH {D.ANCHORS} SELECT CAST(anchor_idx AS BIGINT) AS anchor_idx, CAST(coalesce(r_regionkey, -1) AS INT)
              AS group_idx FROM anchors LEFT JOIN region ON group_key = r_regionkey""")
def group_membership(spark, sf):
    regions = D.table(spark, sf, "region").select(F.col("r_regionkey").alias("group_key"),
                                                  F.col("r_regionkey").alias("group_idx"))
    return A.group_membership(D.anchors(spark, sf), regions).select("anchor_idx", "group_idx")


@register(f"WITH {D.AFFINITY},{D.GROUPS} SELECT item_id, group_idx, round(s, 6) AS s FROM sa")
def group_affinity(spark, sf):
    return A.long_form(group_scores(spark, sf), "sa", "group_idx", "s").withColumn("s", F.round("s", 6))


@register(f"""WITH {D.AFFINITY},{D.GROUPS} SELECT item_id, CAST(group_idx AS INT) AS group_idx FROM (
                SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, group_idx) AS r FROM sa)
              WHERE r = 1""")
def dominant_group(spark, sf):
    return group_scores(spark, sf).select("item_id", A.best_index(F.col("sa")).alias("group_idx"))


@register(f"""WITH {D.AFFINITY},{D.GROUPS} SELECT item_id, group_idx, round((s - lo) / (hi - lo + 1e-6), 6) AS s
              FROM sa JOIN sa_range USING (group_idx)""")
def group_minmax(spark, sf):
    scaled_ = A.group_minmax(materialize(group_scores(spark, sf), "groups"))
    return A.long_form(scaled_, "sa01", "group_idx", "s").withColumn("s", F.round("s", 6))


# -- neighbours, clusters, axes -----------------------------------------------------------------

KNN = f"""{D.ITEMS}, un AS (SELECT idx, {D.unit("v")} AS v FROM items),
sims AS (SELECT a.idx AS src, b.idx AS dst, round(list_dot_product(a.v, b.v), 9) AS sim
         FROM un a JOIN un b ON a.idx <> b.idx),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY sim DESC, dst) AS rank FROM sims)
        WHERE rank <= 10)"""


@register(f"WITH {KNN} SELECT src, dst, CAST(rank AS INT) AS rank, round(sim, 6) AS sim FROM knn")
def knn_exact(spark, sf):
    return N.knn_graph(D.items(spark, sf), 10).withColumn("sim", F.round("sim", 6))


@register(f"WITH {KNN} SELECT src, dst, CAST(rank AS INT) AS rank, round(sim, 6) AS sim FROM knn")
def knn_exact_blocks(spark, sf):
    """The same through the distributed blocks, as if the items were too many to broadcast."""
    edges = N.knn_graph(D.items(spark, sf), 10, max_broadcast_bytes=0, block_rows=512, query_rows=512)
    return edges.withColumn("sim", F.round("sim", 6))


@register("""WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
                               CAST(embedding[3] AS DOUBLE) AS qx, CAST(embedding[4] AS DOUBLE) AS qy FROM embeddings),
             d AS (SELECT a.vec_id AS qid, b.vec_id AS idx,
                          (a.qx - b.x) * (a.qx - b.x) + (a.qy - b.y) * (a.qy - b.y) AS d2 FROM p a, p b)
             SELECT qid, idx, round(sqrt(d2), 6) AS dist FROM (
               SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, idx) AS r FROM d WHERE d2 < 0.05 * 0.05)
             WHERE r = 1""")
def grid_radius_nearest(spark, sf):
    e = D.table(spark, sf, "embeddings")

    def at(i):
        return F.element_at("embedding", i).cast("double")

    asked = e.select(F.col("vec_id").alias("qid"), at(3).alias("x"), at(4).alias("y"))
    held = e.select(F.col("vec_id").alias("idx"), at(1).alias("x"), at(2).alias("y"))
    return N.radius_nearest(asked, held, 0.05).withColumn("dist", F.round("dist", 6))


@register(f"""WITH {D.ITEMS},{D.CELLS}, wc AS (SELECT label, pos, avg(x) AS x FROM cells GROUP BY ALL),
              c AS (SELECT label AS cluster, list(x ORDER BY pos) AS v FROM wc GROUP BY ALL),
              d AS (SELECT item_id, cluster, list_sum([(i.v[k] - c.v[k]) * (i.v[k] - c.v[k])
                                                       for k in range(1, len(c.v) + 1)]) AS d2 FROM items i, c)
              SELECT item_id, CAST(cluster AS INT) AS cluster, round(d2, 6) AS dist2 FROM (
                SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(d2, 9), cluster) AS r FROM d)
              WHERE r = 1""")
def kmeans_assign(spark, sf):
    centroids = D.mean_vectors(spark, sf, "label").select(F.col("label").alias("anchor_idx"), "v")
    assigned = cluster.assign_centroids(D.items(spark, sf), centroids)
    return assigned.select("item_id", "cluster", F.round("dist2", 6).alias("dist2"))


@register()
def kmeans_clusters(spark, sf):
    z = materialize(zscores(spark, sf), "z")
    return cluster.kmeans_clusters(z, vec="z")


@register()
def pca_reduce(spark, sf):
    items = D.items(spark, sf)
    return D.exploded(reduce.apply_pca(items, reduce.fit_pca(items, 48), "item_id"), "item_id", "v")


@register()
def layout_pca(spark, sf):
    z = materialize(zscores(spark, sf), "z")
    axes = ("x", "y", "x3", "y3", "z3")
    return reduce.layout(z).select("item_id", *[F.round(c, 4).alias(c) for c in axes])


@register()
def explained_variance(spark, sf):
    """Variance held by 48 principal axes of the items and 16 latent axes of the texts."""
    items = D.items(spark, sf)
    ratio = float(reduce.fit_pca(items, 48).ratio.sum())
    pca = items.limit(1).select(F.lit("pca").alias("method"), F.lit(ratio).alias("explained"))
    _, lsa = lsa_embed(doc_terms(spark, sf), dim=16)
    return pca.unionByName(lsa.select(F.lit("lsa").alias("method"), "explained"))
