"""Exploratory summaries of an event table with a measure (Q15-Q19)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import ranking


def max_measures(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the maximum of each column (text compares
    lexicographically)."""
    return df.agg(*[F.max(c).alias(f"max_{c}") for c in cols])


def rows_where_equal(df: DataFrame, col: str, value: float) -> DataFrame:
    """Rows whose (text) column equals a number, compared as DOUBLE."""
    return df.filter(F.col(col).cast("double") == value)


def total_by(df: DataFrame, dim, measure: str, name: str = "total") -> DataFrame:
    key = F.col(dim) if isinstance(dim, str) else dim
    return df.groupBy(key).agg(F.sum(measure).alias(name))


def rolling_total_by_period(df: DataFrame, period, measure: str,
                            name: str = "total_off", running: str = "rolling_total") -> DataFrame:
    """Totals per period (NULL periods excluded) with a running sum over
    periods; the series has one row per period."""
    g = df.select(period.alias("period"), F.col(measure)) \
          .filter(F.col("period").isNotNull()) \
          .groupBy("period").agg(F.sum(measure).alias(name))
    return g.withColumn(running, F.sum(name).over(Window.orderBy("period")))


def top_per_period(df: DataFrame, entity: str, period, measure: str, k: int = 5,
                   name: str = "ranking") -> DataFrame:
    """Entities ranked by their total within each (non-NULL) period,
    dense rank <= k."""
    g = df.groupBy(F.col(entity), period.alias("years")).agg(
        F.sum(measure).alias("total_laid_off")).filter(F.col("years").isNotNull())
    return ranking.top_k(g, "years", F.col("total_laid_off").desc(), k, name)
