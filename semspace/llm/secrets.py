"""Secret scan with multipart credential linking (operator 7), in DataFrame functions only.

Each kind of span is a regular expression with a lazy gap before it, so that the lengths of all gaps and
matches give the places in code points; a cheap search for fixed strings decides which texts an expression
has to read. Base kinds are assign, access and hex. Linking adds two weak kinds, that are reported only
next to their complements: ``weak`` (a run of exactly 40 base-64 characters) within SCOPE code points of
an access identifier, and ``endpoint`` (an http or https address) within SCOPE of an access identifier and
of a secret (assign, hex or weak candidate). The interval join bins starts by SCOPE and meets the
smallest and largest start of the three bins around a candidate, which decides whether any lies within
SCOPE; so a text full of candidates costs rows, not pairs, and its bins spread over tasks.

Null texts count as empty: no spans, the digest of the empty string. Repeated rows are scanned each. Spans of
a row are gathered per row only. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep

KINDS = ("assign", "access", "hex", "weak", "endpoint")
SCOPE = 400

# the end of the text ends the last gap: without it, what follows the last match would be tried from every place
_ASSIGN = (r"""(?s)(.*?)(?:((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))|\z)""")
_ACCESS = r"(?s)(.*?)(?:(AKIA[A-Z0-9]{14,})|\z)"
_HEX = r"(?s)(.*?)(?:([0-9a-f]{16,})|\z)"
_WEAK = r"(?s)(.*?)(?:([A-Za-z0-9+/]{40,})|\z)"
_ENDPOINT = r"""(?s)(.*?)(?:(https?://[^\x20\x09-\x0D"'<>]+)|\z)"""


def _lengths(text: Column, pattern: str, group: int) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda s: F.length(s))


def _matches(wanted: Column, text: Column, pattern: str, value: int = 2) -> Column:
    """Array of (through, gap, value): lengths of gap and match together, of the gap, of group ``value``."""
    found = F.arrays_zip(_lengths(text, pattern, 0).alias("through"), _lengths(text, pattern, 1).alias("gap"),
                         _lengths(text, pattern, value).alias("value"))
    return F.when(wanted, found)


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (rid, doc_id), one per row of ``docs``; spans (rid, kind, start, end), where kind is
    the index in KINDS and weak kinds are candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lower(text)
    word = low.contains("password") | low.contains("passwd") | low.contains("secret") | low.contains("token") | \
        low.contains("apikey") | low.contains("api_key")
    access = text.contains("AKIA")
    table = keep(docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",  # fixed by the write
        _matches(word, text, _ASSIGN, 3).alias("m0"), _matches(access, text, _ACCESS).alias("m1"),
        _matches(text.rlike("[0-9a-f]{16}"), text, _HEX).alias("m2"), _matches(access, text, _WEAK).alias("m3"),
        _matches(access & text.contains("http"), text, _ENDPOINT).alias("m4")), "matches")
    parts = []
    for kind in range(len(KINDS)):
        parts.append(table.where(F.size(f"m{kind}") > 0).select("rid", F.lit(kind).alias("kind"), F.posexplode(f"m{kind}").alias("i", "m")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    run = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = every.select("rid", "kind", "m.*", F.sum("m.through").over(run).alias("end"))
    least = F.when(F.col("kind") == 0, F.col("value") >= 12).when(F.col("kind") == 3, F.col("value") == 40).otherwise(F.col("value") > 0)
    placed = placed.where(least).select("rid", "kind", (F.col("end") - F.col("through") + F.col("gap")).alias("start"), "end")
    return table.select("rid", "doc_id"), keep(placed, "spans")


def _near(candidates: DataFrame, anchors: DataFrame, scope: int) -> DataFrame:
    """Candidates (rid, kind, start, end) with an anchor whose start is within ``scope`` of theirs."""
    bins = anchors.groupBy("rid", F.floor(F.col("start") / scope).alias("bin")).agg(
        F.min("start").alias("least"), F.max("start").alias("most"))
    home = F.floor(F.col("start") / scope)
    asked = candidates.select("rid", "kind", "start", "end", F.explode(F.array(home - 1, home, home + 1)).alias("bin"))
    met = asked.join(bins, ["rid", "bin"]).where(
        (F.abs(F.col("start") - F.col("least")) <= scope) | (F.abs(F.col("start") - F.col("most")) <= scope))
    return met.select("rid", "kind", "start", "end").distinct()


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans of ``found`` that are reported."""
    access, weak, endpoint = (found.where(F.col("kind") == k) for k in (1, 3, 4))
    secret = found.where(F.col("kind").isin(0, 2, 3))
    return _near(weak, access, scope).unionByName(_near(_near(endpoint, access, scope), secret, scope))


def _joined(items: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked) per row of ``docs``."""
    rows, found = spans(docs)
    all_spans = found.where("kind < 3").unionByName(linked(found, scope))
    of_row = all_spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("items"))
    joined = rows.join(of_row, "rid", "left").withColumn("items", F.coalesce("items", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")))
    count = lambda k: F.size(F.filter("items", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("items", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("items")).alias("spans"), (count(3) + count(4)).alias("n_linked"))
