"""Layered namespaces (S10): databases of the session catalog.

Raw, staging and analytics tables live in a database each and are used by
their qualified names, from SQL and from DataFrames. Tables are Parquet, in the
shared folder, so that every executor reads what any of them wrote. A fact
table can be bucketed and sorted by its join keys once, after which joins and
aggregations on these keys need no shuffle.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators.sequence import scanned_bytes, staging_folder

LAYERS = ("raw", "staging", "analytics")
BUCKET_BYTES = 256 << 20
MAX_BUCKETS = 1 << 14


class Layers:
    """The layers as databases ``<prefix><layer>``.

    Used as a context, it drops them again at the end, with their tables; a
    warehouse that is to stay calls ``create`` alone and leaves the prefix empty."""

    def __init__(self, spark: SparkSession, names: Sequence[str] = LAYERS, prefix: str = "",
                 folder: str | None = None):
        self.spark, self.names, self.prefix = spark, tuple(names), prefix
        self.folder = folder or f"{staging_folder(spark)}/layers-{uuid.uuid4().hex}"

    def name(self, layer: str, table: str) -> str:
        """The qualified name, for use in SQL."""
        if layer not in self.names:
            raise ValueError(f"no layer {layer!r}: {', '.join(self.names)}")
        return f"`{self.prefix}{layer}`.`{table}`"

    def create(self) -> Layers:
        for n in self.names:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.prefix}{n}` LOCATION '{self.folder}/{n}'")
        return self

    def drop(self) -> None:
        for n in self.names:
            self.spark.sql(f"DROP DATABASE IF EXISTS `{self.prefix}{n}` CASCADE")

    def __enter__(self) -> Layers:
        return self.create()

    def __exit__(self, *_) -> None:
        self.drop()

    def save(self, df: DataFrame, layer: str, table: str, mode: str = "overwrite",
             partition_by: Sequence[str] = (), bucket_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
        """Write ``df`` as a table of the layer; a scan of it.

        ``bucket_by``: rows are dealt to that many buckets by these columns and
        sorted by them (one file per bucket: rows are shuffled to the buckets
        first). Tables to be joined need the same number; the default follows
        the size of the scanned tables, ``spark.sql.shuffle.partitions`` at least."""
        if bucket_by:
            n = buckets or self.bucket_count(df)
            df = df.repartition(n, *bucket_by)
        w = df.write.mode(mode).format("parquet")
        if partition_by:
            w = w.partitionBy(*partition_by)
        if bucket_by:
            w = w.bucketBy(n, *bucket_by).sortBy(*bucket_by)
        w.saveAsTable(self.name(layer, table))
        return self.table(layer, table)

    def table(self, layer: str, table: str) -> DataFrame:
        return self.spark.table(self.name(layer, table))

    def bucket_count(self, *dfs: DataFrame) -> int:
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))
        size = max((scanned_bytes(d) for d in dfs), default=0)
        return max(least, min(MAX_BUCKETS, -(-size // BUCKET_BYTES)))
