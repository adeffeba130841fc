"""Parquet table scans (S1) and name resolution."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def path_of(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str, declared: bool = True) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    Known tables are read with their declared schema: no schema-inference
    job per read, and a file with drifted types fails loudly instead of
    changing the plan. ``declared=False`` infers the schema from the files.
    """
    from ledgerline.sources.schemas import DRIVER
    reader = spark.read
    if declared and name in DRIVER:
        reader = reader.schema(DRIVER[name])
    return reader.parquet(path_of(sf_dir, name))


def register_views(spark: SparkSession, sf_dir: str, names=TABLES,
                   prefix: str = "") -> None:
    """Expose tables as temp views so recipes can be written in SQL."""
    for n in names:
        load(spark, sf_dir, n).createOrReplaceTempView(prefix + n)
