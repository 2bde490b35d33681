"""Reproducible random draws: a number that depends on a key, a seed and a purpose, not on partitions.

The draw is taken from an MD5 digest, so that any engine with MD5 can make the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 2**32


def draw(key: Column, seed: int, purpose: str) -> Column:
    """A number in [0, 1), uniform over keys and independent between purposes. All null keys draw the same number."""
    digest = F.md5(F.concat(F.lit(f"{purpose}/{seed}/"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(_RANGE))


def whole(unit: Column, low: int, high: int) -> Column:
    """A whole number from low to high, both included."""
    return (F.floor(unit * (high - low + 1)) + low).cast("bigint")


def pick(unit: Column, options: Sequence[str]) -> Column:
    """One of the options."""
    return F.element_at(F.array(*map(F.lit, options)), whole(unit, 1, len(options)).cast("int"))
