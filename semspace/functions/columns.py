"""Small helpers for building column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A plain expression used inside a ``transform`` lambda is evaluated again for every array
    element; bound as a lambda variable it is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value.cast("double"), digits)
