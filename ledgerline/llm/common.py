"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.sequence import materialize

BATCH_BYTES = 8 << 20
BATCH_ROWS = 2048
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds (default: 10,000 rows of any length),
    so a worker's memory doesn't depend on the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stage(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back."""
    return materialize(df, f"llm-{tag}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is staged in the block go when it has been written,
    not when the driver's garbage collector finds them."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4 (null for a null id)."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def spare(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores as keep it apart from ``columns``
    (compared as Spark does, without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out
