"""Reading levels as ordinals: always compared by place, never by spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("A1", "A2", "B1", "B2", "C1", "C2")


def ordinal(level: Column) -> Column:
    """1 for the lowest; null for what is no level."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level), F.lit(0)).cast("int")


def level(n: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in LEVELS]), n.cast("int"))


def upper_median(values: Column) -> Column:
    """sorted[n // 2] of an array."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))
