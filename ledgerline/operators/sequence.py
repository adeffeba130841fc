"""Exact, distributed row numbering.

A window without PARTITION BY (``ntile(3) over (order by v)``) or one whose
partition holds a hot key runs in a single task. ``global_row_number``
gives the same exact numbering with all work spread over range partitions:

1. range-partition on the full sort key (the sampler splits a hot value
   across partitions because the key includes the tie-break columns),
   sort inside each partition and tag every row with its partition and
   position (``monotonically_increasing_id``);
2. write the tagged rows once as a parquet table under the cluster's
   reliable ``spark.checkpoint.dir`` and read them back, cutting the
   lineage: partition boundaries are fixed (a re-run would re-sample them)
   and an executor loss cannot renumber rows (a reliable ``checkpoint()``
   would compute the input twice, once to count and once to write);
3. count rows per partition (one row per partition: a proven size bound),
   prefix-sum the counts and broadcast the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import uuid

from ledgerline.session import ensure_checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id = partition << 33 | position
PARTITION_BYTES = 256 << 20
MAX_PARTITIONS = 1 << 15  # rows of the broadcast offsets
_UNKNOWN_SIZE = 1 << 60   # the planner's default for an input without statistics is larger


def materialize(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` as parquet under the session's checkpoint directory (the
    shared, reliable folder on a cluster) and return a scan of it."""
    path = f"{staging_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._ledgerline_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any
    more (what was made of them has been written, too)."""
    for df in staged:
        _delete(df.sparkSession, df._ledgerline_path)


_scopes: list[list[str]] = []


class staged_within:
    """Deletes what was staged in its block, once that has been used up, but for the
    tables in ``keep``::

        with staged_within(spark) as block:
            out = materialize(job(df))
            block.keep(out)

    Nothing that reads the other tables may be left when the block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.made, self.kept = spark, [], set()

    def keep(self, *staged: DataFrame) -> None:
        self.kept.update(df._ledgerline_path for df in staged)

    def __enter__(self) -> staged_within:
        _scopes.append(self.made)
        return self

    def __exit__(self, failed, *_) -> None:
        _scopes[:] = [m for m in _scopes if m is not self.made]
        if failed is None:
            for path in self.made:
                if path not in self.kept:
                    _delete(self.spark, path)


def discard_all(spark: SparkSession) -> None:
    """Delete every table that this application has staged, at its end."""
    _delete(spark, staging_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def staging_folder(spark: SparkSession) -> str:
    """The application's own folder of staged tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerline-stage/{spark.conf.get('spark.app.id', 'shared')}"


def _default_partitions(df: DataFrame) -> int:
    """Range partitions of about ``PARTITION_BYTES`` of the scanned tables,
    ``spark.sql.shuffle.partitions`` at least. Inputs of unknown size count
    as empty."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, min(MAX_PARTITIONS, -(-scanned_bytes(df) // PARTITION_BYTES)))


def scanned_bytes(df: DataFrame) -> int:
    """Size of the tables that ``df`` scans, by the planner's statistics;
    inputs of unknown size count as empty."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(x for x in sizes if x < _UNKNOWN_SIZE)


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_no",
                      partitions: int | None = None) -> DataFrame:
    """``df`` plus ``name`` = 1-based position in ``order`` (which must be a
    total order; add a unique tie-break). The numbered rows are a scan of
    the materialised table.

    ``partitions`` is the number of range partitions, which AQE does not
    change; the default follows the size of the scanned tables."""
    n = partitions or _default_partitions(df)
    tagged = materialize(df.repartitionByRange(n, *order)
                           .sortWithinPartitions(*order)
                           .withColumn("_lr_mid", F.monotonically_increasing_id()), "rownum")
    tagged = (tagged
              .withColumn("_lr_pid", F.shiftright("_lr_mid", _POS_BITS))
              .withColumn("_lr_pos", F.col("_lr_mid").bitwiseAND((1 << _POS_BITS) - 1)))
    counts = tagged.groupBy("_lr_pid").agg(F.count(F.lit(1)).alias("_lr_n"))
    offsets = counts.select(
        "_lr_pid",
        F.coalesce(F.sum("_lr_n").over(
            Window.orderBy("_lr_pid").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("_lr_off"))
    out = tagged.join(F.broadcast(offsets), "_lr_pid")
    return out.withColumn(name, F.col("_lr_off") + F.col("_lr_pos") + 1) \
              .drop("_lr_pid", "_lr_pos", "_lr_mid", "_lr_off")


def ntile_exact(df: DataFrame, order: list[Column], tiles: int, name: str = "tile",
                partitions: int | None = None) -> DataFrame:
    """``ntile(tiles) over (order by ...)`` without a single-partition window.

    With n rows, q = n // tiles and m = n % tiles, the first m tiles hold
    q + 1 rows and the rest q rows, exactly as NTILE assigns them.
    """
    numbered = global_row_number(df, order, "_nt_rn", partitions)
    total = numbered.agg(F.count(F.lit(1))).scalar()
    t = F.lit(tiles)
    q = F.floor(F.col("_nt_n") / t)
    m = F.col("_nt_n") - q * t
    big = m * (q + 1)
    rn = F.col("_nt_rn")
    tile = F.when(rn <= big, F.floor((rn - 1) / (q + 1)) + 1) \
            .otherwise(m + F.floor((rn - big - 1) / q) + 1)
    return numbered.withColumn("_nt_n", total) \
                   .withColumn(name, tile.cast("int")).drop("_nt_rn", "_nt_n")


def lag_exact(df: DataFrame, keys: list[str], order: list[Column],
              values: dict[str, str]) -> DataFrame:
    """Previous row's ``values`` within each key (``lag(v) over (partition by
    keys order by ...)``) for keys of any size.

    Rows are numbered over (keys, order); row r's predecessor is row r - 1 if
    it has the same key. The self-join is on the unique row number, so a key
    holding a third of all rows is spread over every task.
    """
    full_order = [F.col(k).asc_nulls_first() for k in keys] + list(order)
    numbered = global_row_number(df, full_order, "_lg_rn")
    prev = numbered.select(
        (F.col("_lg_rn") + 1).alias("_lg_rn"),
        *[F.col(k).alias(f"_lg_k{i}") for i, k in enumerate(keys)],
        *[F.col(src).alias(f"_lg_v_{dst}") for dst, src in values.items()])
    joined = numbered.join(prev, "_lg_rn", "left")
    same = None
    for i, k in enumerate(keys):
        cond = F.col(k).eqNullSafe(F.col(f"_lg_k{i}"))
        same = cond if same is None else same & cond
    for dst in values:
        joined = joined.withColumn(dst, F.when(same, F.col(f"_lg_v_{dst}")))
    drop = ["_lg_rn"] + [f"_lg_k{i}" for i in range(len(keys))] + \
        [f"_lg_v_{d}" for d in values]
    return joined.drop(*drop)


def running_sums(df: DataFrame, values: dict[str, str], order: list[str], by: list[str] = (),
                 partitions: int | None = None) -> DataFrame:
    """``SUM(v) OVER (PARTITION BY by ORDER BY order)`` with the default RANGE
    frame (peers share the total, NULLs are a group and come first) for every
    ``name: v`` of ``values``, for groups of any size.

    Two-level prefix sums: peers are summed first (combining before the
    shuffle), the sums are dealt to range partitions by (by, order), so that a
    group with a third of the rows is spread over many of them, and staged.
    Each partition forms its own prefix sums; what a group has in the
    partitions before is added from a table with at most one row per
    partition, since only its first group can have begun earlier."""
    keys = [f"_rs{i}" for i in range(len(by) + len(order))]
    group, sort = keys[:len(by)], keys[len(by):]
    kinds = df.agg(*[F.sum(v).alias(n) for n, v in values.items()]).schema
    n = partitions or _default_partitions(df)
    peers = df.groupBy(*[F.col(c).alias(k) for c, k in zip([*by, *order], keys)]) \
              .agg(*[F.sum(v).alias(f"_rs_{i}") for i, v in enumerate(values.values())])
    order_by = [F.col(k).asc_nulls_first() for k in keys]
    peers = materialize(peers.repartitionByRange(n, *order_by).withColumn("_rs_part", F.spark_partition_id()),
                        "running")
    names = [f"_rs_{i}" for i in range(len(values))]
    inside = Window.partitionBy("_rs_part", *group).orderBy(*order_by[len(by):]) \
                   .rowsBetween(Window.unboundedPreceding, 0)
    local = peers.select(*keys, "_rs_part", *[F.sum(c).over(inside).alias(c) for c in names])
    # one row per group and partition; rows of a group: as many as partitions
    sums = peers.groupBy("_rs_part", *group).agg(*[F.sum(c).alias(c) for c in names])
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_rs_part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy("_rs_part"))
    before = sums.select(F.col("_rs_part").alias("_rs_p"), *[F.col(g).alias(f"{g}b") for g in group],
                         first.alias("_rs_first"), *[F.sum(c).over(earlier).alias(f"{c}b") for c in names]) \
                 .filter("_rs_first > 1").drop("_rs_first")
    same = F.col("_rs_part") == F.col("_rs_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}b"))
    both = [F.when(F.col(c).isNotNull() | F.col(f"{c}b").isNotNull(),
                   F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}b", F.lit(0))).cast(kinds[name].dataType).alias(name)
            for c, name in zip(names, values)]
    totals = materialize(local.join(F.broadcast(before), same, "left").select(*keys, *both), "running-totals")
    match = None
    for c, k in zip([*by, *order], keys):
        cond = F.col(c).eqNullSafe(F.col(k))
        match = cond if match is None else match & cond
    return df.drop(*values).join(totals, match).drop(*keys)


def sliding(df: DataFrame, order: list[Column], before: int, columns, block_rows: int = 1 << 16) -> DataFrame:
    """Columns over a row and the ``before`` rows ahead of it in ``order`` (a
    total order), without a single-task window. Rows are numbered exactly and
    cut into blocks of ``block_rows``; the last ``before`` rows of a block are
    also given to the next one. ``columns(window)`` maps names to columns over
    the window of a block."""
    if not 0 <= before < block_rows:
        raise ValueError("a row's neighbours must fit into one block")
    at = F.col("_sl_rn") - 1
    own = F.floor(at / block_rows)
    numbered = global_row_number(df, order, "_sl_rn")
    spread = numbered.withColumn("_sl_block", F.explode(
        F.when(at % block_rows >= block_rows - before, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy("_sl_block").orderBy("_sl_rn")
    out = spread.select("*", *[c.alias(n) for n, c in columns(window).items()])
    return out.filter(F.col("_sl_block") == own).drop("_sl_rn", "_sl_block")


def expand_range(df: DataFrame, lo: Column, hi: Column, name: str,
                 chunk_rows: int = 1 << 16, partitions: int | None = None) -> DataFrame:
    """One output row per integer ``i`` in ``[lo, hi]`` for every input row
    (``explode(sequence(lo, hi))``), with large ranges split into chunks of
    ``chunk_rows`` that are hash-spread across tasks before expanding, so a
    count covering a third of the data is not generated by one task."""
    n = partitions or _default_partitions(df)
    with_bounds = df.withColumn("_er_lo", lo.cast("long")).withColumn("_er_hi", hi.cast("long"))
    chunks = with_bounds.withColumn(
        "_er_c", F.explode(F.sequence(F.lit(0).cast("long"),
                                      F.floor((F.col("_er_hi") - F.col("_er_lo")) / chunk_rows))))
    chunks = chunks.filter(F.col("_er_hi") >= F.col("_er_lo")) \
                   .repartition(n, F.xxhash64(*[F.col(c) for c in df.columns], F.col("_er_c")))
    start = F.col("_er_lo") + F.col("_er_c") * chunk_rows
    stop = F.least(F.col("_er_hi"), start + chunk_rows - 1)
    return chunks.withColumn(name, F.explode(F.sequence(start, stop))) \
                 .drop("_er_lo", "_er_hi", "_er_c")
