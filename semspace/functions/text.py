"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The strings pandas' CSV reader takes as missing by default.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

SHORT_LIMIT = 240  # fixed value: the length of a short text
# Fixed value: how numbers are written; Java would also take suffixes ("1d") and hexadecimals.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def na_to_null(c: Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def strip(c: Column) -> Column:
    """Remove Unicode blanks from both ends (``trim`` only knows U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def try_number(c: Column) -> Column:
    """Lenient parse: text that is no number, and NaN, become null."""
    text = c.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def item_text(name: Column, description: Column, limit: int | None = None) -> Column:
    """Name and whole description; ``limit`` cuts the description for an embedder that needs it."""
    body = strip(F.coalesce(description, F.lit("")))
    body = body if limit is None else F.substring(body, 1, limit)
    return F.when(F.length(body) > 0, F.concat(name, F.lit(". "), body)).otherwise(name)


def item_text_plain(name: Column, description: Column) -> Column:
    return F.concat(name, F.lit(". "), F.coalesce(description, F.lit("")))


def anchor_text(name: Column, gloss: Column) -> Column:
    return F.concat(name, F.lit(". "), gloss)


def short_text(c: Column, limit: int = SHORT_LIMIT) -> Column:
    line = F.translate(strip(F.coalesce(c, F.lit(""))), "\n", " ")
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def space_case(c: Column) -> Column:
    """CamelCase to words."""
    # The two patterns.
    c = F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1 $2")


def item_url(base: str, name: Column) -> Column:
    return F.concat(F.lit(base), name)


def pair_key(a: Column, b: Column) -> Column:
    """Order-free key of two element keys; the order is that of the strings, so i10 < i2."""
    return F.concat_ws("+", F.array_sort(F.array(a, b)))
