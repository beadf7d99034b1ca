"""Joins on group keys, where a missing key is a group like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on `keys`, which both sides have; NULL meets NULL. The keys of the left side stay."""
    marked = {k: f"_right_{k}" for k in keys}
    other = right.select(*[F.col(f"`{c}`").alias(marked.get(c, c)) for c in right.columns])
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{m}`")) for k, m in marked.items()])
    return left.join(other, same, how).drop(*marked.values())
