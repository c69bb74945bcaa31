"""Item, anchor and short texts; tokens, TF-IDF, latent vectors; the batch embedder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stopwords import ENGLISH
from ..operators import text_features as X
from ..operators.embed import embed, hashing_embedder
from . import data as D
from .registry import register


def description():
    return F.when(F.col("lang") != "fr", F.concat(F.lit("  \n"), F.col("text"), F.lit("\t\n ")))


SQL_DESCRIPTION = "CASE WHEN lang <> 'fr' THEN '  ' || chr(10) || text || chr(9) || chr(10) || ' ' END"
SQL_STRIPPED = f"trim(coalesce({SQL_DESCRIPTION}, ''), ' ' || chr(9) || chr(10))"


@register(f"""SELECT doc_id, CASE WHEN length({SQL_STRIPPED}) > 0
                THEN source || '. ' || {SQL_STRIPPED} ELSE source END AS item_text FROM documents""")
def item_text(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.item_text(F.col("source"), description()).alias("item_text"))


@register(f"SELECT doc_id, source || '. ' || coalesce({SQL_DESCRIPTION}, '') AS item_text FROM documents")
def item_text_plain(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.item_text_plain(F.col("source"), description()).alias("item_text"))


@register("SELECT n_name || '. ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def anchor_text(spark, sf):
    region = D.table(spark, sf, "region")
    named = D.table(spark, sf, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.select(T.anchor_text(F.col("n_name"), F.col("r_name")).alias("text"))


@register(f"""WITH s AS (SELECT doc_id, replace({SQL_STRIPPED}, chr(10), ' ') AS t FROM documents)
              SELECT doc_id, CASE WHEN length(t) > 240 THEN left(t, 240) || '…' ELSE t END AS d FROM s""")
def short_text(spark, sf):
    return D.documents(spark, sf).select("doc_id", T.short_text(description()).alias("d"))


@register(r"""SELECT p_partkey, regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g'),
                '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g') AS title
              FROM (SELECT p_partkey, replace(p_type || 'Of' || upper(left(p_name, 1)) || substr(p_name, 2), ' ', '')
                    AS name FROM part)""")
def space_case(spark, sf):
    name = F.concat("p_type", F.lit("Of"), F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))
    return D.table(spark, sf, "part").select(
        "p_partkey", T.space_case(F.translate(name, " ", "")).alias("title"))


@register("""SELECT event_id, array_to_string(list_sort(['i' || user_id, 'i' || CAST(floor(value) AS BIGINT)]), '+')
             AS pair FROM events""")
def pair_key(spark, sf):
    a = F.concat(F.lit("i"), F.col("user_id").cast("string"))
    b = F.concat(F.lit("i"), F.floor("value").cast("string"))
    return D.table(spark, sf, "events").select("event_id", T.pair_key(a, b).alias("pair"))


SEED_TABLE = """
all_words AS (SELECT n_nationkey AS ord, n_name AS name, CASE WHEN n_regionkey = 0 THEN 'root'
              ELSE 'kind_' || n_regionkey END AS kind FROM nation)"""


def word_table(spark, sf):
    kind = F.when(F.col("n_regionkey") == 0, "root").otherwise(F.concat_ws("_", F.lit("kind"), "n_regionkey"))
    return D.table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"),
                                               kind.alias("kind"))


@register(f"""WITH {SEED_TABLE} SELECT name, kind, 'seed' AS part FROM all_words WHERE kind = 'root'
              UNION ALL SELECT name, kind, 'word' FROM all_words WHERE kind <> 'root'""")
def seed_split(spark, sf):
    words = word_table(spark, sf).select("name", "kind")
    return (words.where(F.col("kind") == "root").withColumn("part", F.lit("seed"))
            .unionByName(words.where(F.col("kind") != "root").withColumn("part", F.lit("word"))))


@register("""SELECT r_name AS name, 'root' AS kind, r_regionkey AS ord FROM region
             UNION ALL SELECT n_name, 'kind_' || n_regionkey, n_nationkey FROM nation""")
def seeds_union_words(spark, sf):
    roots = D.table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("root").alias("kind"),
                                                F.col("r_regionkey").alias("ord"))
    words = D.table(spark, sf, "nation").select(
        F.col("n_name").alias("name"), F.concat_ws("_", F.lit("kind"), "n_regionkey").alias("kind"),
        F.col("n_nationkey").alias("ord"))
    return roots.unionByName(words)


SQL_STOP = ", ".join(f"'{w}'" for w in ENGLISH)
TERMS = rf"""
stop AS (SELECT [{SQL_STOP}] AS words),
toks AS (SELECT doc_id, [w for w in regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}')
                         if NOT list_contains(stop.words, w)] AS w FROM documents, stop),
terms AS (SELECT doc_id, list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS terms FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM terms) GROUP BY ALL),
vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 3
          ORDER BY n DESC, term LIMIT 50000)"""


def doc_terms(spark, sf):
    return D.documents(spark, sf).select("doc_id", X.word_ngrams(F.col("text")).alias("terms"))


@register(f"WITH {TERMS} SELECT doc_id, term, tf FROM tf")
def token_ngrams(spark, sf):
    return X.term_counts(doc_terms(spark, sf))


@register(f"WITH {TERMS} SELECT term, n, df FROM vocab")
def tfidf_vocab(spark, sf):
    return X.vocabulary(doc_terms(spark, sf))


@register(f"""WITH {TERMS}, size AS (SELECT count(*) AS docs FROM documents),
              raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + docs) / (1 + df)) + 1) AS w
                      FROM tf JOIN vocab USING (term), size),
              norms AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM raw GROUP BY doc_id)
              SELECT doc_id, term, round(w / n, 6) AS weight FROM raw JOIN norms USING (doc_id)""")
def tfidf_weights(spark, sf):
    terms = doc_terms(spark, sf)
    weights = X.tfidf_weights(terms, X.fit_tfidf(terms))
    return weights.select("doc_id", "term", F.round("weight", 6).alias("weight"))


@register()
def lsa_embed(spark, sf):
    vectors, _ = X.lsa_embed(doc_terms(spark, sf), dim=16)
    return D.exploded(vectors, "doc_id", "v")


@register(f"""SELECT CAST(doc_id AS VARCHAR) AS item_id, 64 AS dim, 'hashing' AS model, 1.0::DOUBLE AS norm
              FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def embed_batch(spark, sf):
    texts = D.documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("item_id"), T.item_text(F.col("source"), F.col("text")).alias("text"))
    done = D.table(spark, sf, "labels").select(F.col("doc_id").alias("item_id"))
    made = embed(texts, hashing_embedder(64), 64, "hashing", done, workers=8)
    length = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    return made.where(F.col("error").isNull()).select(
        "item_id", F.size("v").alias("dim"), "model", F.round(F.sqrt(length), 4).alias("norm"))
