"""Seeded randomness as a pure function of a seed and a row key.

An md5 prefix gives the same number on every engine, task and retry, so a lost
executor recomputes exactly the rows it had.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 4294967296.0


def text_key(*parts: Column | str | int) -> Column:
    columns = [F.lit(str(p)) if isinstance(p, (str, int)) else p.cast("string") for p in parts]
    return F.concat_ws("|", *columns)


def digest(*parts: Column | str | int) -> Column:
    """Hex digest that orders rows pseudo-randomly."""
    return F.md5(text_key(*parts))


def hash32(*parts: Column | str | int) -> Column:
    """Integer in [0, 2^32)."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """Double in [0, 1)."""
    return hash32(*parts) / F.lit(HASH_SPACE)


def hash60(*parts: Column | str | int) -> Column:
    """Integer in [0, 2^60)."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("long")


def prefix_length(rows: int, each: int = 1000) -> int:
    """Hex digits of a digest whose prefixes part `rows` rows into groups of about `each`."""
    return max(1, min(15, math.ceil(math.log(max(rows, 1) / each, 16)) if rows > each else 1))


def draw(size: Column, *parts: Column | str | int) -> Column:
    """Integer in 1..size, for sizes far below 2^60."""
    return F.lit(1) + hash60(*parts) % size
