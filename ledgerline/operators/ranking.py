"""Rankings, top-k per group, tiers (W8-W12, O5-O7, Q19, Q23, Q24, Q26, Q29,
Q33, Q37).

``rank``/``dense_rank``/``row_number`` filtered with ``<= k`` or ``= 1`` plan
as ``WindowGroupLimit``: each map task keeps only its local top-k per group
before the shuffle, so a category holding a third of all rows ships at most
k (plus ties) rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators.sequence import ntile_exact

_RANKERS = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}


def _cols(xs) -> list:
    return [xs] if isinstance(xs, (str, Column)) else list(xs)


def add_rank(df: DataFrame, by, order, name: str, method: str = "dense_rank",
             tiebreak: Sequence[Column] = ()) -> DataFrame:
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order), *tiebreak) if by \
        else Window.orderBy(*_cols(order), *tiebreak)
    return df.withColumn(name, _RANKERS[method]().over(w))


def top_k(df: DataFrame, by, order, k: int, name: str = "rnk",
          method: str = "dense_rank", tiebreak: Sequence[Column] = ()) -> DataFrame:
    """Rows whose rank within ``by`` is at most ``k`` (ties kept for rank and
    dense_rank; ``row_number`` needs a unique ``tiebreak``)."""
    return add_rank(df, by, order, name, method, tiebreak).filter(F.col(name) <= k)


def nth(df: DataFrame, by, order, n: int, name: str = "rnk",
        method: str = "dense_rank") -> DataFrame:
    """Rows ranked exactly ``n`` within ``by`` (all ties)."""
    return add_rank(df, by, order, name, method).filter(F.col(name) == n)


def tiers(df: DataFrame, value: str, key: str, labels: Sequence[str],
          name: str = "tier", descending: bool = True) -> DataFrame:
    """NTILE(len(labels)) by ``value`` (ties broken by ``key``), labelled; by
    the exact range-partitioned NTILE, not a single-partition window."""
    v = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_last()
    order = [v, F.col(key).asc()]
    tiled = ntile_exact(df, order, len(labels), "_tier_no")
    label = None
    for i, lab in enumerate(labels, start=1):
        cond = F.col("_tier_no") == i
        label = F.when(cond, F.lit(lab)) if label is None else label.when(cond, F.lit(lab))
    return tiled.withColumn(name, label).drop("_tier_no")
