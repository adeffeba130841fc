"""Typed file sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.operators.sequence import discard, materialize


CSV = {"quote": '"', "escape": '"'}  # as RFC 4180, both ways


def read_typed_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool = True) -> DataFrame:
    """CSV with a header, read with a declared schema (never inferred).

    Columns are found by their name in the header, whatever their order, after
    trimming (``"UniqueID "`` is ``UniqueID``); a missing one is an error, and
    so is a cell that doesn't parse, in ANSI mode or not. Quoted cells may hold line
    ends; a file is then read by one task. ``multi_line=False`` is for files
    without such cells: these are split like any text, however large."""
    text = spark.read.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                              multiLine=multi_line, **CSV).csv(path)
    at = {c.strip(): c for c in text.columns}
    if missing := [f.name for f in schema.fields if f.name not in at]:
        raise ValueError(f"{path} has no column {missing}")

    def typed(f):
        cell = F.col("`" + at[f.name].replace("`", "``") + "`")
        value = cell.try_cast(f.dataType)
        bad = F.raise_error(F.concat(F.lit(f"CAST_INVALID_INPUT in column {f.name}: "), cell))
        return F.when(cell.isNull() | value.isNotNull(), value).otherwise(bad).alias(f.name)
    return text.select(*[typed(f) for f in schema.fields])


def empty_clone(df: DataFrame) -> DataFrame:
    """Schema-only copy (``CREATE TABLE x AS SELECT * FROM y WHERE 1=0``)."""
    return df.limit(0)


def schema_catalog(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type, nullable) rows for a frame's schema."""
    spark = df.sparkSession
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable)
            for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(
        rows, "ordinal int, column_name string, data_type string, nullable boolean")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Positional column match with cast to the target types
    (``INSERT INTO t SELECT ...`` semantics)."""
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"expected {len(schema.fields)} columns, got {len(df.columns)}")
    return df.select(*[F.col(c).cast(f.dataType).alias(f.name)
                       for c, f in zip(df.columns, schema.fields)])


def append_load(df: DataFrame, path: str, schema: StructType,
                fmt: str = "parquet") -> None:
    """Append rows to a typed table, matching columns by position."""
    conform(df, schema).write.mode("append").format(fmt).save(path)


def write_extract(df: DataFrame, path: str, fmt: str = "parquet",
                  partition_by: tuple[str, ...] = (), mode: str = "overwrite",
                  max_files: int | None = None) -> None:
    """Materialise a result (CTAS / dashboard extract).

    ``max_files`` coalesces small results into few files without a shuffle.
    """
    out = df.coalesce(max_files) if max_files else df
    w = out.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                      **CSV)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def update_rows(spark: SparkSession, path: str, partition_by: Sequence[str], where: Column,
                values: Mapping[str, Column]) -> int:
    """``UPDATE t SET ... WHERE ...`` on a partitioned Parquet table, rewriting
    only the partitions that hold a row to change; the number of them.

    The partitions are found from the columns that ``where`` reads, then read,
    changed and staged, and put in place by a dynamic partition overwrite:
    files of all other partitions stay as they are. The staged copy means that
    a job that fails while writing can be run again from it. The list of
    touched partitions comes to the driver (it lists the folders, too).
    Partition columns can't be changed."""
    if clash := set(values) & set(partition_by):
        raise ValueError(f"partition columns can't be updated: {sorted(clash)}")
    table = spark.read.parquet(path)
    touched = [tuple(r) for r in table.filter(where).select(*partition_by).distinct().collect()]
    if not touched:
        return 0
    keep = F.lit(False)
    for t in touched:
        here = F.lit(True)
        for c, v in zip(partition_by, t):
            here = here & (F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
        keep = keep | here
    changed = table.filter(keep).select(*[
        F.when(where, values[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in values else F.col(c)
        for c in table.columns])
    staged = materialize(changed, "partitions")
    staged.repartition(*partition_by, F.pmod(F.monotonically_increasing_id(), F.lit(8))) \
          .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
    discard(staged)
    return len(touched)
