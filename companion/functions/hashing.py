"""Seeded, re-evaluation-safe pseudo-randomness from md5.

A row's "random" number is a digest of the seed and its own key, so a
recomputed partition draws exactly the same values (unlike ``rand()`` or a
Python ``random`` call inside a UDF), and DuckDB reproduces every digest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# the first 15 hex digits (60 bits) of a digest fit a signed bigint
PREFIX_HEX = 15


def seeded_digest(seed: int | str, *cols: Column | str) -> Column:
    """``md5("seed:c1:c2:...")`` as 32 hex characters."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hex_prefix(digest: Column) -> Column:
    """First 60 bits of a hex digest as a non-negative bigint."""
    return F.conv(F.substring(digest, 1, PREFIX_HEX), 16, 10).cast("long")


def draw_index(digest: Column, n: Column) -> Column:
    """Uniform index in ``[0, n)`` from a digest."""
    return F.pmod(hex_prefix(digest), n)
