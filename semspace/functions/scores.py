"""Score and axis expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import half_even

MEDIA = ("film", "tv", "lit")
UNUSED = "unused"
# Palette size, scale of the axes, colour of what has none.
PALETTE_SLOTS = 24
AXIS_SCALE = 60
DEFAULT_COLOR = "#9aa0b8"


def share(part: Column, total: Column, digits: int = 3) -> Column:
    return F.when(total > 0, half_even(part / total, digits)).otherwise(F.lit(0.0))


def dominant(counts: Sequence[tuple[str, Column]], none: str = UNUSED) -> Column:
    """Name of the largest count, the earlier one on ties; ``none`` when all are zero."""
    largest = F.greatest(*[c for _, c in counts])
    out = F.when(largest == 0, none)
    for name, c in counts:
        out = out.when(c == largest, name)
    return out


def popularity_size(total: Column, largest: Column, base: float = 2.0, span: float = 3.4) -> Column:
    """Marker size; (2.0, 3.4) on the 2D map, (1.5, 3.2) in 3D."""
    scaled = F.when(largest > 0, F.log1p(total) / F.log1p(largest)).otherwise(F.lit(0.0))
    return F.lit(base) + F.lit(span) * scaled


def palette_slot(cluster: Column, slots: int = PALETTE_SLOTS) -> Column:
    return cluster % slots


def share_axis(part: Column, total: Column) -> Column:
    return part / F.greatest(total, F.lit(1)) * 2 - 1


def popularity_axis(total: Column, largest: Column) -> Column:
    scaled = F.when(largest > 0, F.log1p(total) / F.log1p(largest)).otherwise(F.lit(0.0))
    return scaled * 2 - 1


def cluster_axis(cluster: Column, clusters: int) -> Column:
    return cluster / F.lit(max(clusters - 1, 1)) * 2 - 1
