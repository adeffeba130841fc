"""Operator 2: exact deduplication of a stream of documents with keyed state.

Texts are equal when they are identical after every run of white space has
become one space. Three steps, each restartable from its checkpoint:

1. *Arrivals*: a stream over the document files notes for each row its id, the
   SHA-256 digest of the normalised text and a content locator, the file and
   the row in it. It appends to a table, each file once.
2. *State*: a second stream over the arrivals keeps, in RocksDB and without
   expiry, one entry per digest: the smallest id with its locator (the stable
   identifier) and the number of rows. Spark combines rows of a digest before
   the shuffle, so a group of any size is one row per task. The state is read
   back with the state data source.
3. *Hits*: rows whose digest has come more than once are fetched by locator
   and compared byte for byte: the least and the greatest text of a digest,
   again combined before the shuffle, must be the same. Digests for which they
   aren't are grouped by the text itself.

With new files in the folder, a call with the same ``work`` folder reads only
those and adds to the state.

Defined results: null text counts as empty; of equal texts the row with the
smallest id stays, null ids last, then the first by locator (repeated rows:
one stays); ``keep_id`` is null only if no row of the group has an id; an
empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import stage
from ledgerline.session import ensure_checkpoint_dir

WHITE_SPACE = r"[\x20\x09-\x0D]+"
EVER = "36500d"  # files added later may have any age
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def _located(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("body"),
                       F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.row_index").alias("row"))


def _run(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def _as_glob(path: str) -> str:
    """The same path as a pattern: a stream takes a single file only so."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def arrivals(spark: SparkSession, path: str, work: str, id_col: str = "doc_id",
             text_col: str = "text", key: Callable[[Column], Column] = lambda d: d,
             files_per_batch: int | None = None) -> DataFrame:
    """Append (doc_id, file, row, text_sha256, key) of new files to a table."""
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFileAge", EVER)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    digest = F.sha2(F.col("body"), 256)
    rows = _located(source.parquet(_as_glob(path)), id_col, text_col) \
        .select("doc_id", "file", "row", digest.alias("text_sha256"), key(digest).alias("key"))
    _run(rows.writeStream.format("parquet").option("path", f"{work}/arrivals")
         .option("checkpointLocation", f"{work}/arrivals-log")
         .trigger(availableNow=True).outputMode("append").start())
    return spark.read.schema("doc_id long, file string, row long, text_sha256 string, key string") \
                .parquet(f"{work}/arrivals")


def _first() -> Column:
    """Sort value of a row within its group, from which the row can be told."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("file"), F.col("row"))


def keyed_state(spark: SparkSession, seen: DataFrame, work: str) -> DataFrame:
    """(key, first, group_size) of everything that ever arrived."""
    # on disk, in bounded memory, and open only while a task uses it
    wanted = {f"spark.sql.streaming.stateStore.{k}": v for k, v in (
        ("providerClass", ROCKSDB), ("rocksdb.boundedMemoryUsage", "true"), ("unloadOnCommit", "true"))}
    old = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(seen.schema).option("maxFileAge", EVER).parquet(f"{work}/arrivals")
        state = rows.groupBy("key").agg(F.min(_first()).alias("first"),
                                        F.count(F.lit(1)).alias("group_size"))
        _run(state.writeStream.format("noop").outputMode("update")
             .option("checkpointLocation", f"{work}/state").trigger(availableNow=True).start())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    kept = spark.read.format("statestore").load(f"{work}/state").select("key.*", "value.*")
    return kept.toDF("key", "first", "group_size")


def dedup_stream(spark: SparkSession, path: str, work: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", key: Callable[[Column], Column] = lambda d: d,
                 files_per_batch: int | None = None) -> DataFrame:
    """One row per document of the Parquet table at ``path``. ``key`` maps the
    digest to the state's key (tests use a short one, to see it collide)."""
    if not spark.read.parquet(path).head(1):
        return spark.createDataFrame([], "doc_id long, keep_id long, group_size long,"
                                         " kept boolean, text_sha256 string")
    work = work or f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-stream-{uuid.uuid4().hex}"
    seen = arrivals(spark, path, work, id_col, text_col, key, files_per_batch)
    # one file scan per side, so that a large group is split between tasks
    state = stage(keyed_state(spark, seen, work), "dedup-state")
    hits = seen.join(state.filter("group_size > 1").select("key"), "key", "left_semi") \
               .select("file", "row", "key")
    bodies = _located(spark.read.parquet(path), id_col, text_col).join(hits, ["file", "row"])
    clash = stage(bodies.groupBy("key").agg(F.min("body").alias("low"), F.max("body").alias("high"))
                  .filter("low != high").select("key"), "dedup-clash")
    if not clash.isEmpty():  # digests shared by different texts: those go by their text
        own = bodies.join(clash, "key", "left_semi")
        exact = own.groupBy("key", "body").agg(F.min(_first()).alias("first"),
                                               F.count(F.lit(1)).alias("group_size"))
        by_row = own.join(exact, ["key", "body"]).select("file", "row", "first", "group_size")
        seen_by_row = seen.join(clash, "key", "left_semi").join(stage(by_row, "dedup-by-text"), ["file", "row"])
        rest = seen.join(clash, "key", "left_anti").join(state, "key")
        rows = rest.unionByName(seen_by_row.select(rest.columns))
    else:
        rows = seen.join(state, "key")
    return rows.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
                       ((F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row")))
                       .alias("kept"), "text_sha256")


def op2_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_stream(spark, f"{sf_dir}/documents.parquet")


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM d WINDOW same AS (PARTITION BY text_sha256)
"""
