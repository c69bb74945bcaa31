"""Registered queries of the subpackage, each next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, fingerprints, jaccard, lines, merkle, mixing, neighbours, packing, quality, rules, secrets, separators, warc
from .common import documents, keep, prepare, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(strlen(html), 0) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM m
"""


@_register(OP1_SQL)
def op1_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@_register()
def op2_sign_hash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


@_register()
def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@_register()
def op4_drr_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


OP5_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (CAST('0x' || substr(md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
           / 4503599627370496::DOUBLE AS u
  FROM documents
), r AS (SELECT doc_id, source, size, u / (1 - u) AS odds, length(bin(size)) AS digits FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, sum(source_size) OVER ()::BIGINT AS whole,
              ([3, 1, 2])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM s0),
s2 AS (SELECT *, coalesce(sum(source_size) OVER f, 0)::BIGINT AS done, sum(w) OVER ()::BIGINT AS ws,
              coalesce(sum(w) OVER f, 0)::BIGINT AS wd FROM s1
       WINDOW f AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, (3 * whole - 4 * done) * w > 4 * source_size * (ws - wd) AS is_full FROM s2),
s4 AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN source_size END) OVER (), 0)::BIGINT AS cut,
              coalesce(sum(CASE WHEN NOT is_full THEN w END) OVER (), 0)::BIGINT AS open FROM s3),
s5 AS (SELECT source, source_size, CASE WHEN is_full THEN (2 * source_size)::DOUBLE
              ELSE (w * (3 * whole - 4 * cut))::DOUBLE / (2 * open)::DOUBLE END AS target FROM s4),
s AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM s5),
c0 AS (SELECT source, digits, sum(size)::BIGINT AS words FROM r GROUP BY source, digits),
c1 AS (SELECT c0.*, s.source_size, s.target, s.copies, s.target - s.copies * s.source_size AS rest,
              coalesce(sum(words) OVER (PARTITION BY c0.source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS above,
              sum(digits * words) OVER (PARTITION BY c0.source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS below
       FROM c0 JOIN s ON c0.source IS NOT DISTINCT FROM s.source),
c2 AS (SELECT *, (rest - above) * digits > below AS certain FROM c1),
c3 AS (SELECT *, rest - coalesce(sum(CASE WHEN certain THEN words END) OVER (PARTITION BY source), 0)::BIGINT AS open,
              coalesce(sum(CASE WHEN NOT certain THEN digits * words END) OVER (PARTITION BY source), 0)::BIGINT AS share FROM c2),
c AS (SELECT *, CASE WHEN certain THEN 1.0::DOUBLE
                ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN share > 0 THEN open / share::DOUBLE ELSE 0.0::DOUBLE END * digits)) END AS pi FROM c3),
k AS (SELECT r.doc_id, r.source, r.size, c.source_size, c.target, c.copies, c.rest,
             CASE WHEN pi > 0 THEN odds * ((1 - pi) / pi) ELSE odds + 1e18::DOUBLE END AS rank
      FROM r JOIN c ON r.source IS NOT DISTINCT FROM c.source AND r.digits = c.digits),
j AS (SELECT doc_id, size, source_size, target, copies, rest,
             sum(size) OVER (PARTITION BY source ORDER BY rank, size, doc_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM k)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (copies + CASE WHEN until - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM j
"""


@_register(OP5_SQL)
def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = mixing.allocate(keep(mixing.sized(docs, ["doc_id"]), "sizes"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@_register()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.removed_lines(documents(spark, sf_dir)).drop("h")


_EITHER = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_PATTERNS = (
    r"""(?s)(.*?)(%s["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))""" % _EITHER,
    r"(?s)(.*?)(AKIA[A-Z0-9]{14,})",
    r"(?s)(.*?)([0-9a-f]{16,})",
    r"(?s)(.*?)([A-Za-z0-9+/]{40,})",
    r"""(?s)(.*?)(https?://[^\x20\x09-\x0D"''<>]+)""",
)
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS kind, unnest(regexp_extract_all(t, '{p}', 0)) AS a, unnest(regexp_extract_all(t, '{p}', 1)) AS g, "
    f"unnest(regexp_extract_all(t, '{p}', {4 if k == 0 else 2})) AS v, "
    f"unnest(range(len(regexp_extract_all(t, '{p}', 0)))) AS i FROM d"
    for k, p in enumerate(_PATTERNS))
OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
p AS (SELECT *, (sum(length(a)) OVER (PARTITION BY doc_id, kind ORDER BY i))::BIGINT AS stop FROM f),
s AS (SELECT doc_id, kind, stop - length(a) + length(g) AS start, stop FROM p
      WHERE CASE kind WHEN 0 THEN length(v) >= 12 WHEN 3 THEN length(v) = 40 ELSE true END),
r AS (SELECT * FROM s WHERE kind < 3 OR (kind = 3 AND EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.kind = 1
          AND abs(x.start - s.start) <= 400))
      OR (kind = 4 AND EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.kind = 1 AND abs(x.start - s.start) <= 400)
          AND EXISTS (SELECT 1 FROM s x WHERE x.doc_id = s.doc_id AND x.kind IN (0, 2, 3) AND abs(x.start - s.start) <= 400))),
n AS (SELECT doc_id, kind, start, (['assign', 'access', 'hex', 'weak', 'endpoint'])[kind + 1] || ':' || start || ':' || stop AS x FROM r),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             count(*) FILTER (kind > 2) AS n_linked, string_agg(x, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
             string_agg(x, ',' ORDER BY start, kind) AS spans FROM n GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN g USING (doc_id)
"""


@_register(OP7_SQL)
def op7_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


@_register()
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


@_register()
def op9_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


@_register()
def op10_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(documents(spark, sf_dir))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW best AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST)
"""


@_register(OP11_SQL)
def op11_golomb_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.exact_groups(documents(spark, sf_dir))


_LETTERS = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate(audit.FILTERS))
OP12_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps,
             min(doc_id) OVER (PARTITION BY t) AS least FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
      FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
             + CASE WHEN 100 * caps > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN w.doc_id > least THEN 16 ELSE 0 END AS mask FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM m GROUP BY part, mask),
f(x, b) AS (VALUES {_LETTERS}),
p AS (SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits
      FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31
      AND length(f1.x || f2.x || f3.x || f4.x || f5.x) = 5 AND len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS b, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS prior
      FROM p, range(1, 6) r(step)),
o AS (SELECT part, filter_order, step, b, n, good, toxic, mask, (mask & b) > 0 AS fails, (mask & prior) > 0 AS gone FROM c, s),
g AS (SELECT part, filter_order, step, b, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM o GROUP BY part, filter_order, step, b)
SELECT * EXCLUDE (b), (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley FROM g
"""


@_register(OP12_SQL)
def op12_packed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


_CRC_BIT = "CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), "
        "lambda a, c: list_reduce(list_prepend(xor(a, c), range(8)), lambda v, i: " + _CRC_BIT + ")), 4294967295)")


def _leaf_sql(text: str) -> str:
    fields = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({fields})"


OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC} % 3 = 0 THEN
       {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed FROM documents),
o AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
n AS (SELECT tree, 0 AS lv, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS size FROM o
      UNION ALL
      SELECT tree, lv + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((size + 7) // 8) FROM n WHERE size > 1
      GROUP BY tree, lv, pos // 8),
r AS (SELECT tree, lv, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM n WHERE size > 1 GROUP BY tree, lv, pos // 8),
sub AS (SELECT tree, lv AS height, h AS subroot FROM n WHERE size = 1),
u AS (SELECT 0 AS lv, tree AS pos, subroot AS h, count(*) OVER () AS size FROM sub
      UNION ALL
      SELECT lv + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((size + 7) // 8) FROM u WHERE size > 1 GROUP BY lv, pos // 8),
ur AS (SELECT lv, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM u WHERE size > 1 GROUP BY lv, pos // 8),
top AS (SELECT h AS root FROM u WHERE size = 1),
f AS (SELECT doc_id, leaf, tree, pos AS leaf_pos, 0 AS lv, pos, coalesce(changed, leaf) AS v, '' AS sib FROM o
      UNION ALL
      SELECT doc_id, leaf, f.tree, leaf_pos, f.lv + 1, pos // 8,
             sha256(array_to_string(hs[1:pos % 8], '') || v || array_to_string(hs[pos % 8 + 2:], '')),
             sib || array_to_string(hs[1:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
      FROM f JOIN r ON r.tree = f.tree AND r.lv = f.lv AND r.run = f.pos // 8),
g AS (SELECT doc_id, leaf, f.tree, leaf_pos, subroot, 0 AS lv, f.tree AS pos, v, sib FROM f JOIN sub ON sub.tree = f.tree AND sub.height = f.lv
      UNION ALL
      SELECT doc_id, leaf, tree, leaf_pos, subroot, g.lv + 1, pos // 8,
             sha256(array_to_string(hs[1:pos % 8], '') || v || array_to_string(hs[pos % 8 + 2:], '')),
             sib || array_to_string(hs[1:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
      FROM g JOIN ur ON ur.lv = g.lv AND ur.run = g.pos // 8)
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, v AS folded_root, v = root AS verified
FROM g, top WHERE g.lv = (SELECT max(lv) FROM u)
"""


@_register(OP13_SQL)
def op13_midstate_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(documents(spark, sf_dir))
