"""Vector expressions on array columns, evaluated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import let

NORM_EPSILON = 1e-9


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda total, x: total + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    v = as_double(v)
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))


def l2_normalize_eps(v: Column) -> Column:
    """``v / (|v| + 1e-9)``."""
    v = as_double(v)
    return let(norm(v) + F.lit(NORM_EPSILON), lambda n: F.transform(v, lambda x: x / n))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x + y)


def abs_max(v: Column) -> Column:
    return F.array_max(F.transform(as_double(v), F.abs))


def quantize(v: Column, scale: Column) -> Column:
    """Signed 8-bit codes, round half to even, clipped to [-127, 127]."""
    return F.transform(
        as_double(v),
        lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x / scale * 127.0)))
        .cast("tinyint"))


def dequantize(q: Column, scale: Column) -> Column:
    return l2_normalize_eps(F.transform(q, lambda x: x.cast("double") * scale / 127.0))
