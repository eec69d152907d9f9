"""Repeatable pseudo-random numbers from a key.

``rand``, ``sampleBy`` and ``randomSplit`` depend on how rows are spread over partitions; a hash
of the key gives every row the same draw in every run and on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 32


def draw(key: Column, seed: int = 42) -> Column:
    """A whole number in [0, 2^32) from key and seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed: int = 42) -> Column:
    return draw(key, seed) / F.lit(float(RANGE))
