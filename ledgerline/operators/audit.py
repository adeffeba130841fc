"""Data-quality audits (C3, C8, C11-C18, C20, C24, C32). Audits return
DataFrames and never change their input."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Keys (single or composite) that occur more than once, with counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def reconcile_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows before, rows after, rows removed (the second count is a
    scalar subquery; nothing is collected to the driver)."""
    b = before.agg(F.count(F.lit(1)).alias("before_rows"))
    return b.withColumn("after_rows", after.agg(F.count(F.lit(1))).scalar()) \
            .withColumn("removed_rows", F.col("before_rows") - F.col("after_rows"))


def dedup_counts(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """One row: rows before, rows after de-duplicating on ``keys`` (all
    columns by default), rows removed — from a single grouping pass over
    ``df`` (partial aggregation), not two scans."""
    keys = list(keys or df.columns)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.sum("_n").alias("before_rows"), F.count(F.lit(1)).alias("after_rows")) \
            .withColumn("removed_rows", F.col("before_rows") - F.col("after_rows"))


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str] | str) -> DataFrame:
    """Child rows without a parent (``LEFT JOIN ... WHERE p.k IS NULL``),
    written as an anti join. ``on`` maps child column -> parent column."""
    on = {on: on} if isinstance(on, str) else dict(on)
    p = parent.select(*[F.col(pc).alias(f"_p_{cc}") for cc, pc in on.items()])
    cond = None
    for cc in on:
        c = child[cc] == p[f"_p_{cc}"]
        cond = c if cond is None else cond & c
    return child.join(p, cond, "left_anti")


def orphans_labelled(child: DataFrame, parents: Sequence[tuple[str, DataFrame, str, str]],
                     name: str = "orphan_type") -> DataFrame:
    """Child rows missing any parent, labelled by the first missing parent.

    ``parents`` is a list of (label, parent_df, child_col, parent_col); the
    parent keys are de-duplicated first so the left joins cannot fan out.
    """
    out = child
    label = None
    for i, (lab, parent, cc, pc) in enumerate(parents):
        keys = parent.select(F.col(pc).alias(f"_pk{i}")).distinct() \
                     .withColumn(f"_hit{i}", F.lit(True))
        out = out.join(keys, out[cc] == keys[f"_pk{i}"], "left").drop(f"_pk{i}")
        miss = F.col(f"_hit{i}").isNull()
        label = F.when(miss, F.lit(lab)) if label is None else label.when(miss, F.lit(lab))
    hits = [f"_hit{i}" for i in range(len(parents))]
    return out.withColumn(name, label).filter(F.col(name).isNotNull()).drop(*hits)


def missing_members(child: DataFrame, dim: DataFrame, col: str,
                    dim_col: str | None = None) -> DataFrame:
    """Distinct non-NULL child values absent from ``dim``
    (``SELECT DISTINCT c FROM child WHERE c NOT IN (SELECT d FROM dim)``):
    NOT IN is NULL-aware, so a NULL in ``dim`` yields no rows at all."""
    dim_col = dim_col or col
    vals = child.select(col).filter(F.col(col).isNotNull()).distinct()
    keys = dim.select(F.col(dim_col).alias("_d"))
    missing = vals.join(keys.filter(F.col("_d").isNotNull()),
                        F.col(col) == F.col("_d"), "left_anti")
    has_null = keys.agg(F.max(F.col("_d").isNull().cast("int"))).scalar()
    return missing.filter(F.coalesce(has_null, F.lit(0)) == 0)


def complete_dimension(child: DataFrame, dim: DataFrame, col: str,
                       label_col: str, dim_col: str | None = None) -> DataFrame:
    """``dim`` plus one row per missing member, labelled by its own key."""
    dim_col = dim_col or col
    miss = missing_members(child, dim, col, dim_col)
    added = miss.select(F.col(col).alias(dim_col),
                        F.col(col).cast("string").alias(label_col))
    return dim.select(dim_col, label_col).unionByName(added)


def violations(df: DataFrame, rules: Mapping[str, Column], keep: Sequence[str],
               name: str = "rule") -> DataFrame:
    """One row per (row, violated rule) in a single scan. A rule whose
    predicate is NULL counts as passed."""
    tags = F.array(*[F.when(F.coalesce(pred, F.lit(False)), F.lit(r)) for r, pred in rules.items()])
    hit = F.filter(tags, lambda x: x.isNotNull())
    return df.select(*keep, F.explode(hit).alias(name))


def null_audit(df: DataFrame, cols: Sequence[str], blank_as_missing: bool = False) -> DataFrame:
    """One row: total rows and the number of missing values per column
    (``count(*) FILTER (WHERE c IS NULL)``)."""
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for c in cols:
        miss = F.col(c).isNull()
        if blank_as_missing and dict(df.dtypes)[c] == "string":
            miss = miss | (F.trim(F.col(c)) == "")
        aggs.append(F.count_if(miss).alias(f"missing_{c}"))
    return df.agg(*aggs)


def inconsistent_attributes(df: DataFrame, key: str, attrs: Sequence[str]) -> DataFrame:
    """Keys with more than one distinct value in any attribute."""
    g = df.groupBy(key).agg(*[F.count_distinct(a).alias(f"n_{a}") for a in attrs])
    cond = None
    for a in attrs:
        c = F.col(f"n_{a}") > 1
        cond = c if cond is None else cond | c
    return g.filter(cond)


def pattern_audit(df: DataFrame, col: str, regex: str) -> DataFrame:
    """Distinct values matching ``regex``."""
    return df.select(col).filter(F.col(col).rlike(regex)).distinct()


def value_histogram(df: DataFrame, col: str, name: str = "n") -> DataFrame:
    """Value and ``count(col)`` (a NULL group counts 0)."""
    return df.groupBy(col).agg(F.count(col).alias(name))


def domain_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column, for inspection."""
    return df.select(col).distinct()


def group_centroid(df: DataFrame, key: Column | str, means: Mapping[str, str],
                   maxes: Mapping[str, str] = {}) -> DataFrame:
    """One row per key: mean of some columns, max of others."""
    k = F.col(key) if isinstance(key, str) else key
    aggs = [(F.sum(src).cast("double") / F.count(src)).alias(dst) for dst, src in means.items()]
    aggs += [F.max(src).alias(dst) for dst, src in maxes.items()]
    return df.groupBy(k).agg(*aggs)


class Observed:
    """Counts taken while a job runs anyway (C8, C17): rows, and rows without a
    value per column, of any point of a plan. They are there once the plan has
    been written; no scan of their own is made. A stage that Spark runs again
    after losing its output is counted again."""

    def __init__(self, df: DataFrame, cols: Sequence[str] = ()):
        from pyspark.sql import Observation
        self.cols, self._seen = tuple(cols), Observation()
        self.df = df.observe(self._seen, F.count(F.lit(1)).alias("rows"),
                             *[F.count_if(F.col(c).isNull()).alias(f"missing {c}") for c in cols])

    @property
    def rows(self) -> int:
        return self._seen.get["rows"]

    @property
    def missing(self) -> dict[str, int]:
        return {c: self._seen.get[f"missing {c}"] for c in self.cols}
