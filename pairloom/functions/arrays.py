"""Array expressions for token ids, masks and vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(value: int, length: Column | int) -> Column:
    """``length`` copies of ``value`` as an array of longs (none when ``length`` is negative)."""
    length = F.lit(length) if isinstance(length, int) else length
    return F.array_repeat(F.lit(value).cast("long"), length.cast("int"))


def pad_right(ids: Column, length: Column | int, value: int = 0) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return F.concat(ids, filled(value, length - F.size(ids)))


def pad_left(ids: Column, length: Column | int, value: int = 0) -> Column:
    return F.concat(filled(value, F.lit(length) - F.size(ids)), ids)


def ones_like(ids: Column) -> Column:
    return filled(1, F.size(ids))


def last(items: Column) -> Column:
    """Last element, or null for an empty array."""
    return F.get(items, F.size(items) - 1)


def as_text(items: Column, separator: str = " ") -> Column:
    """Elements joined into one string, for comparing arrays across engines."""
    return F.array_join(items.cast("array<string>"), separator)


def euclidean_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value made once, however often and in whatever lambda ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
