"""Running totals, growth, moving averages, gaps, roll-ups and streaks
(W1-W7, A12, F13-F15, Q9, Q18, Q22, Q25, Q34-Q36, Q38).

Running totals, moving averages and growth take rows of any number: prefix
sums and windows over numbered blocks. For calendar-grain series (one row per
day/month, bounded by the calendar, not by the data volume) ``series=True``
plans a plain window instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import day_start, month_start, seconds_between, week_start
from ledgerline.operators.sequence import (expand_range, lag_exact, running_sums,
                                            sliding)


def _cols(xs) -> list:
    return [xs] if isinstance(xs, (str, Column)) else list(xs)


def _sorted(xs) -> list[Column]:
    return [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in _cols(xs)]


def running_total(df: DataFrame, value: str, order, by=(), name: str = "running_total",
                  series: bool = False) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY by ORDER BY order)`` with the default
    RANGE frame: rows with equal order values (peers) share the total.

    Rows of any number and groups of any size: two-level prefix sums
    (``sequence.running_sums``). ``series=True`` is for input that has one row
    per calendar period and group, for which a plain window will do; ``order``
    may then be an expression, too."""
    if not series:
        return running_sums(df, {name: value}, _cols(order), _cols(by))
    w = Window.partitionBy(*_cols(by)).orderBy(*_cols(order)) if by else \
        Window.orderBy(*_cols(order))
    return df.withColumn(name, F.sum(value).over(w))


def share_of_total(df: DataFrame, value: str, order, name: str = "running_total",
                   pct_name: str = "grand_total_percentage", digits: int = 2,
                   series: bool = False) -> DataFrame:
    """Running total plus its percentage of the grand total (a scalar
    subquery)."""
    grand = df.agg(F.sum(value)).scalar()
    out = running_total(df, value, order, name=name, series=series)
    pct = F.col(name).cast("double") / grand.cast("double") * 100
    return out.withColumn(pct_name, F.round(pct, digits))


def moving_average(df: DataFrame, value: str, order, rows: int = 7,
                   name: str = "moving_avg", digits: int | None = 2, series: bool = False) -> DataFrame:
    """Mean of the current and ``rows - 1`` preceding rows (a row frame:
    missing days are not filled, the first rows average fewer values).
    ``order`` should be total. ``series=True``: one row per calendar period."""
    def columns(w):
        avg = F.avg(value).over(w.rowsBetween(-(rows - 1), 0))
        return {name: F.round(avg, digits) if digits is not None else avg}

    if series:
        return df.withColumns(columns(Window.orderBy(*_cols(order))))
    return sliding(df, _sorted(order), rows - 1, columns)


def growth(df: DataFrame, value: str, order, prev_name: str = "prev_value",
           name: str = "growth_pct", digits: int = 2, series: bool = False) -> DataFrame:
    """Previous row's value and the change in percent. The previous row is
    the previous *existing* period; gaps are not filled. ``order`` should be
    total. ``series=True``: one row per calendar period."""
    def columns(w):
        return {prev_name: F.lag(value).over(w)}

    out = df.withColumns(columns(Window.orderBy(*_cols(order)))) if series else \
        sliding(df, _sorted(order), 1, columns)
    pct = F.try_divide(F.col(value) - F.col(prev_name), F.col(prev_name)) * 100
    return out.withColumn(name, F.round(pct, digits))


def gap(df: DataFrame, key: str, ts: str, tiebreak: str, prev_name: str = "prev_ts",
        gap_name: str = "gap_seconds") -> DataFrame:
    """Previous event time per key and the gap in seconds (first event: NULL).
    Rows are numbered globally and joined to their predecessors, so a key with
    a third of all events is not one task."""
    order = [F.col(ts).asc_nulls_first(), F.col(tiebreak).asc_nulls_first()]
    out = lag_exact(df, [key], order, {prev_name: ts})
    return out.withColumn(gap_name, seconds_between(ts, prev_name))


def calendar_rollup(df: DataFrame, ts: str, value: str,
                    names=("monthly", "weekly", "daily"), out: str = "revenue") -> DataFrame:
    """``GROUP BY ROLLUP(month, week, day)``: detail rows, subtotals (NULL in
    the rolled-up levels) and the grand total; plus ``grouping_level``."""
    levels = [month_start(ts).alias(names[0]), week_start(ts).alias(names[1]),
              day_start(ts).alias(names[2])]
    return df.rollup(*levels).agg(F.sum(value).alias(out),
                                  F.grouping_id().alias("grouping_level"))


def streaks(df: DataFrame, key: str, ts: str, min_len: int = 3,
            distinct_months: bool = False, chunk_rows: int = 1 << 16) -> DataFrame:
    """Runs of consecutive calendar months per key with at least ``min_len``
    rows (gaps-and-islands on ``month - row_number months``).

    Faithful default: every input row counts, so two rows in one month make
    different islands. The work is done on (key, month, n) counts: the
    per-key window runs over at most one row per calendar month, and each
    month's n row numbers are regenerated in chunks of ``chunk_rows`` that
    are hash-spread before expansion, so a hot key or hot month is split.
    """
    months = df.select(F.col(key), month_start(ts).alias("_m")) \
               .groupBy(key, "_m").agg(F.count(F.lit(1)).alias("_n"))
    if distinct_months:
        months = months.withColumn("_n", F.lit(1).cast("long"))
    w = Window.partitionBy(key).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    rows = expand_range(months.select(key, "_m", "_before", "_n"),
                        F.col("_before") + 1, F.col("_before") + F.col("_n"), "_rn",
                        chunk_rows=chunk_rows).select(key, "_m", "_rn")
    # month index minus row number; an integer avoids calendar overflow
    rows = rows.withColumn("_grp", F.year("_m") * 12 + F.month("_m") - F.col("_rn"))
    return (rows.groupBy(key, "_grp")
                .agg(F.min("_m").alias("streak_start"), F.max("_m").alias("streak_end"),
                     F.count(F.lit(1)).alias("consecutive_months"))
                .filter(F.col("consecutive_months") >= min_len)
                .drop("_grp"))


def cube_report(df: DataFrame, dims: dict, value: str, out: str = "revenue") -> DataFrame:
    """``GROUP BY CUBE(dims)``: every combination of subtotals, with
    ``grouping_level`` telling subtotal NULLs from data NULLs."""
    return df.cube(*[c.alias(n) for n, c in dims.items()]).agg(
        F.sum(value).alias(out), F.grouping_id().alias("grouping_level"))
