"""Set operations and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """``UNION`` (distinct) by position, NULLs equal."""
    return reduce(lambda a, b: a.union(b), frames).distinct()


def except_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """``EXCEPT`` (distinct)."""
    return a.subtract(b)


def with_lookups(df: DataFrame, lookups: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Left-join lookup tables on a shared column; unmatched rows keep NULL
    lookup values and the duplicate key column is not repeated."""
    out = df
    for lk, key in lookups:
        out = out.join(lk, key, "left")
    return out


def union_with_lookups(frames: Sequence[DataFrame],
                       lookups: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """UNION of same-shaped yearly tables, then left lookups (the recipe's
    shape: CTE of unions joined to segment and meal tables)."""
    return with_lookups(union_distinct(frames), lookups)
