"""Keyed pseudo-randomness.

A value drawn from a hash of (seed, key) is the same on every attempt of every task and
under any partitioning, which ``rand()`` is not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_hash(seed: int | str, *keys: str | Column) -> Column:
    """Hex digest that puts rows in a seeded order: ``md5("seed:key[:key...]")``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys]))


def unit_interval(text: Column) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of ``md5(text)``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
