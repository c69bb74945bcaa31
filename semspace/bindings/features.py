"""Sources, cleaning, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scores import MEDIA
from ..functions.text import na_to_null, try_number
from ..operators import align as AL
from ..operators import clean as C
from ..operators import features as X
from ..plans import feature_build
from ..sources import tables
from ..sources.storage import scratch_path
from . import data as D
from .registry import register

COUNTS = [f"n_{m}" for m in MEDIA]
SHARES = [f"frac_{m}" for m in MEDIA]


@register("SELECT doc_id, lang, source, text FROM documents")
def scan_csv(spark, sf):
    path = f"{scratch_path(spark, 'documents')}/table.csv"
    tables.write_table(D.documents(spark, sf).select("doc_id", "lang", "source", "text"), path)
    back = tables.scan_csv(spark, path, multiline=True)
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", "text")


@register("SELECT CAST(l_partkey AS VARCHAR) AS item_id, count(*) AS n FROM lineitem GROUP BY l_partkey")
def csv_occurrences(spark, sf):
    """Occurrences per item, read from a CSV of which only the id column is wanted."""
    path = f"{scratch_path(spark, 'occurrences')}/film_tropes.csv"
    tables.write_table(D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("trope_id"), "l_returnflag"), path)
    return tables.read_occurrences(spark, path).groupBy("item_id").agg(F.count("*").alias("n"))


@register("SELECT event_id, CASE WHEN event_type <> 'error' THEN event_type END AS event_type FROM events")
def na_tokens(spark, sf):
    token = F.when(F.col("event_type") == "error", "NA").otherwise(F.col("event_type"))
    return D.table(spark, sf, "events").select("event_id", na_to_null(token).alias("event_type"))


@register("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 100")
def limit_first_n(spark, sf):
    return C.first_n(D.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", 100)


@register("""SELECT CAST(doc_id AS VARCHAR) AS item_id, source AS name, text AS description FROM documents
             WHERE lang <> 'fr'""")
def dropna_subset(spark, sf):
    docs = D.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("item_id"),
        F.when(F.col("lang") != "fr", F.col("source")).alias("name"), F.col("text").alias("description"), "n_chars")
    return C.drop_missing(docs, ["item_id", "name", "description"], ["item_id", "name"])


@register("""SELECT doc_id, lang, source, n_chars FROM (
               SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dedup_keep_first(spark, sf):
    docs = D.table(spark, sf, "documents").select("text", "doc_id", "lang", "source", "n_chars")
    return C.keep_first(docs, ["text"], "doc_id").drop("text")


@register("""SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view') THEN value END AS number FROM events""")
def try_numeric(spark, sf):
    text = (F.when(F.col("event_type") == "error", F.col("event_type"))
            .when(F.col("event_type") == "view", F.lit("NaN")).otherwise(F.col("value").cast("string")))
    return D.table(spark, sf, "events").select("event_id", try_number(text).alias("number"))


@register("SELECT CAST(l_partkey AS VARCHAR) AS item_id, count(*) AS n FROM lineitem GROUP BY 1")
def count_by_key(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("item_id"))
    return X.count_by_key(rows, "item_id").withColumn("item_id", F.col("item_id").cast("string"))


def counted(spark, sf):
    return X.feature_counts(D.catalogue(spark, sf), X.occurrences(D.events(spark, sf)))


@register(f"WITH {D.FEATURES} SELECT item_id, n_film, n_tv, n_lit, n_total FROM counted")
def feature_counts(spark, sf):
    return counted(spark, sf).select("item_id", *COUNTS, "n_total")


@register(f"WITH {D.FEATURES} SELECT item_id, frac_film, frac_tv, frac_lit FROM mixed")
def media_mix(spark, sf):
    return X.media_mix(counted(spark, sf)).select("item_id", *SHARES)


@register(f"WITH {D.FEATURES} SELECT item_id, dominant_media FROM mixed")
def dominant_medium(spark, sf):
    return X.dominant_medium(counted(spark, sf)).select("item_id", "dominant_media")


@register(f"WITH {D.FEATURES} SELECT item_id, name, gender_ratio FROM features")
def name_score_lookup(spark, sf):
    scored = X.name_score_lookup(D.catalogue(spark, sf), D.scores(spark, sf))
    return scored.select("item_id", "name", "gender_ratio")


def features(spark, sf):
    return feature_build.feature_table(D.catalogue(spark, sf), D.events(spark, sf), D.scores(spark, sf))


@register(f"""WITH {D.FEATURES} SELECT item_id, name, description, n_film, n_tv, n_lit, n_total, frac_film,
              frac_tv, frac_lit, dominant_media, gender_ratio FROM features""")
def feature_table(spark, sf):
    return features(spark, sf)


@register(f"WITH {D.FEATURES} SELECT dominant_media, count(*) AS n FROM features GROUP BY 1")
def category_counts(spark, sf):
    return X.category_counts(X.dominant_medium(counted(spark, sf)))


@register(f"""WITH {D.FEATURES} SELECT count(*) AS items, CAST(sum(n_film) AS BIGINT) AS film_rows,
              CAST(sum(n_tv) AS BIGINT) AS tv_rows, CAST(sum(n_lit) AS BIGINT) AS lit_rows,
              count(gender_ratio) AS scored FROM features""")
def feature_metrics(spark, sf):
    return X.feature_metrics(features(spark, sf))


@register("SELECT doc_id AS item_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def align_features(spark, sf):
    scored = D.table(spark, sf, "labels").withColumnRenamed("doc_id", "item_id")
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"))
    return AL.align_features(docs, scored)


@register("SELECT doc_id AS item_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return AL.pending(docs, D.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id")))


@register("SELECT doc_id AS item_id, n_chars, quality FROM documents JOIN labels USING (doc_id)")
def vector_inner_align(spark, sf):
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "n_chars")
    stored = D.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"), "quality")
    return AL.with_vectors(docs, stored)


@register("""SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
             UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def row_parity(spark, sf):
    return C.row_parity(D.table(spark, sf, "documents"), D.table(spark, sf, "labels"), "doc_id")


@register("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders""")
def dense_index(spark, sf):
    orders = D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.dense_index(orders, ["o_totalprice", "o_orderkey"], small_rows=1000).select("o_orderkey", "idx")
