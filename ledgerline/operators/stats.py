"""Distribution summaries (percentiles, correlations)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.sequence import global_row_number


def nearest_rank_percentiles(df: DataFrame, value: str, key: str,
                             percents: Sequence[int] = (25, 50, 75, 90)) -> DataFrame:
    """Exact nearest-rank percentiles: the value at position ceil(p/100 * n)
    in ascending order (ties broken by ``key``). Positions come from the
    distributed numbering, so no task holds all values (``percentile``
    would buffer the whole column in one aggregate). NULLs have no rank."""
    numbered = global_row_number(df.select(value, key).filter(F.col(value).isNotNull()),
                                 [F.col(value).asc_nulls_first(), F.col(key).asc()], "_rn")
    n = numbered.agg(F.count(F.lit(1)).alias("_n"))
    wanted = n.select(F.explode(F.array(*[F.struct(F.lit(p).alias("percentile"),
                                                   F.greatest(F.lit(1), F.ceil(F.col("_n") * p / 100))
                                                   .alias("_rn")) for p in percents])).alias("w")) \
              .select("w.*")
    return numbered.join(F.broadcast(wanted), "_rn").select("percentile", F.col(value).alias("value"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], digits: int = 9) -> DataFrame:
    """Pearson correlation of every column pair, one aggregation pass."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                 F.round(F.col(f"{a}__{b}"), digits).alias("corr")) for a, b in pairs])).alias("c")) \
              .select("c.*")


SKETCH_K = 1000
# ranks are off by less than this share of the rows, with 99 % confidence for
# each one asked for (KLL: about 2.446 / k ** 0.9433)
RANK_ERROR = 2.446 / SKETCH_K ** 0.9433


def sketches(df: DataFrame, by: Sequence, value: str, name: str = "sketch", k: int = SKETCH_K) -> DataFrame:
    """A quantile sketch of ``value`` per group: a few KB whatever its rows, to be
    stored and merged upwards. NULLs don't count."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias(name))


def merged(df: DataFrame, by: Sequence, name: str = "sketch", k: int = SKETCH_K) -> DataFrame:
    """Sketches of finer groups merged into those of ``by``."""
    return df.groupBy(*by).agg(F.kll_merge_agg_double(F.col(name), F.lit(k)).alias(name))


def sketch_percentiles(df: DataFrame, percents: Sequence[int], name: str = "sketch") -> DataFrame:
    """(percentile, value, n) rows for each sketch: a value whose rank is within
    ``RANK_ERROR`` of the one asked for, and the rows sketched."""
    got = F.explode(F.array(*[F.struct(F.lit(p).alias("percentile"), F.kll_sketch_get_quantile_double(
        F.col(name), F.lit(p / 100)).alias("value")) for p in percents]))
    rest = [c for c in df.columns if c != name]
    return df.filter(F.kll_sketch_get_n_double(name) > 0) \
             .select(*rest, F.kll_sketch_get_n_double(name).alias("n"), got.alias("_p")).select(*rest, "n", "_p.*")
