"""Cleaning operators.

Each is ``DataFrame -> DataFrame`` and can be chained with
``DataFrame.transform``. Per-key choices use aggregates (``min_by``/
``max_by``) rather than windows: they aggregate partially before the
shuffle, so a key holding a third of all rows is not one sort task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import blank_to_null as _blank, fold_key
from ledgerline.operators.sequence import expand_range, materialize


def normalize_strings(df: DataFrame, trim: Sequence[str] = (), lower: Sequence[str] = (),
                      blank_to_null: Sequence[str] = ()) -> DataFrame:
    """One projection: TRIM (then LOWER) the listed columns; blank -> NULL."""
    out = []
    for c in df.columns:
        e = F.col(c)
        if c in trim or c in lower or c in blank_to_null:
            e = F.trim(e)
        if c in lower:
            e = F.lower(e)
        if c in blank_to_null:
            e = F.nullif(e, F.lit(""))
        out.append(e.alias(c) if e is not None else F.col(c))
    return df.select(*out)


def value_to_null(df: DataFrame, cols: Sequence[str], value) -> DataFrame:
    """Replace a sentinel (0, '') by NULL in the listed columns."""
    return df.select(*[F.nullif(F.col(c), F.lit(value)).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def dedup_exact(df: DataFrame, cols: Sequence[str] | None = None,
                fold: Sequence[str] = ()) -> DataFrame:
    """Full-row de-duplication; NULLs compare equal.

    Columns in ``fold`` compare case- and accent-insensitively; among rows
    equal under folding the smallest original row is kept (deterministic).
    """
    cols = list(cols or df.columns)
    if not fold:
        return df.dropDuplicates(cols)
    keys = [fold_key(c).alias(f"_fk_{c}") if c in fold else F.col(c).alias(f"_fk_{c}")
            for c in cols]
    rest = [c for c in df.columns]
    g = df.select(*keys, F.struct(*rest).alias("_row")).groupBy(*[f"_fk_{c}" for c in cols]) \
          .agg(F.min("_row").alias("_row"))
    return g.select("_row.*")


CI_AI = "UNICODE_CI_AI"  # neither case nor accents matter


def collated(c: Column | str, collation: str = CI_AI) -> Column:
    """A text column whose comparisons, groups and joins follow ``collation``."""
    return F.collate(F.col(c) if isinstance(c, str) else c, collation)


def dedup_collated(df: DataFrame, cols: Sequence[str], collation: str = CI_AI) -> DataFrame:
    """One row per group of rows whose ``cols`` are equal under the collation (NULLs
    are equal): the least of them as plain bytes, other columns included. Groups
    are Spark's own string collation, so nothing is folded beforehand."""
    kinds = dict(df.dtypes)
    keys = [(collated(c, collation) if kinds[c] == "string" else F.col(c)).alias(f"_ck_{c}") for c in cols]
    g = df.select(*keys, F.struct(*df.columns).alias("_row")).groupBy(*[f"_ck_{c}" for c in cols]) \
          .agg(F.min("_row").alias("_row"))
    return g.select("_row.*")


def join_collated(left: DataFrame, right: DataFrame, left_col: str, right_col: str, how: str = "inner",
                  collation: str = CI_AI) -> DataFrame:
    """Join on text that is equal under the collation. ``LIKE`` takes no such
    text: prefixes are compared folded (``functions.text.fold_key``)."""
    return left.join(right, collated(left[left_col], collation) == collated(right[right_col], collation), how)


def dedup(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column | str],
          keep: str = "first") -> DataFrame:
    """One row per key: the first (smallest ``order_by``) or last (greatest).

    ``order_by`` should be unique within a key. Implemented as
    ``min_by``/``max_by`` over a struct of the row: partial aggregation.
    """
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = F.min_by(row, order) if keep == "first" else F.max_by(row, order)
    return df.groupBy(*keys).agg(pick.alias("_row")).select("_row.*")


def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None,
                   name: str = "row_num") -> DataFrame:
    """The surplus copies: for every group of equal rows (over ``cols``) with
    n > 1, rows numbered 2..n (copies are identical, so which one is shown
    does not matter)."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    out = expand_range(g, F.lit(2), F.col("_n"), name)
    return out.select(*cols, F.col(name).cast("int").alias(name))


def _key(key: str, fold: bool):
    return fold_key(key) if fold else F.col(key)


def _donors(df: DataFrame, key: str, target: str, tiebreak: str, blank_is_null: bool,
            fold: bool = False):
    # No filter: rows without a value get a NULL ordering key, which min_by
    # skips, and a NULL-key group never matches the equi-join back. Keeping
    # filters out lets both uses of ``df`` share one exchange (a filter would
    # be pushed below an upstream aggregate and defeat exchange reuse).
    value = _blank(target) if blank_is_null else F.col(target)
    donors = df.select(_key(key, fold).alias("_k"), value.alias("_v"), F.col(tiebreak).alias("_t"))
    has = F.col("_v").isNotNull()
    # staged: with a plain shuffle on either side AQE can split a hot key
    return materialize(donors.groupBy("_k").agg(
        F.min_by("_v", F.when(has, F.struct(F.col("_t"), F.col("_v")))).alias("_donor"),
        F.count_if(has).alias("_donors")), "donors")


def fill_from_group(df: DataFrame, key: str, target: str, tiebreak: str,
                    blank_is_null: bool = True, fold: bool = False) -> DataFrame:
    """Fill NULL (and blank) ``target`` from another row with the same ``key``.

    With several donors the one with the smallest ``tiebreak`` wins (a
    join-update leaves this unspecified). NULL keys never match. ``fold``
    matches keys case- and accent-insensitively (an ``_ai_ci`` collation).
    """
    donors = _donors(df, key, target, tiebreak, blank_is_null, fold).select("_k", "_donor")
    cur = _blank(target) if blank_is_null else F.col(target)
    out = df.join(donors, _key(key, fold) == F.col("_k"), "left").drop("_k")
    filled = F.coalesce(cur, F.col("_donor")) if blank_is_null else \
        F.coalesce(F.col(target), F.col("_donor"))
    return out.select(*[filled.alias(c) if c == target else F.col(c) for c in df.columns])


def donor_preview(df: DataFrame, key: str, target: str, tiebreak: str,
                  show: Sequence[str] = (), blank_is_null: bool = True,
                  fold: bool = False) -> DataFrame:
    """Rows that would be filled, with the chosen donor value and the number
    of candidate donors (one row per target row, not one per donor pair)."""
    donors = _donors(df, key, target, tiebreak, blank_is_null, fold)
    cur = _blank(target) if blank_is_null else F.col(target)
    cols = list(dict.fromkeys([*show, key, target]))
    targets = df.filter(cur.isNull()).select(*cols)
    return targets.join(donors, _key(key, fold) == F.col("_k"), "left").select(
        *cols, F.col("_donor").alias("donor_value"),
        F.coalesce(F.col("_donors"), F.lit(0)).alias("donor_count"))


def drop_unmeasured(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """``DELETE WHERE m1 IS NULL AND m2 IS NULL``: rows where the predicate is
    true go; rows where it is NULL or false stay."""
    pred = None
    for m in measures:
        p = F.col(m).isNull()
        pred = p if pred is None else pred & p
    return df.filter(~F.coalesce(pred, F.lit(False)))


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)
