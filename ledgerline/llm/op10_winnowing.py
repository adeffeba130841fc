"""Operator 10: document fingerprints by winnowing.

Every run of ``k`` code points of the text gets a hash; of each ``w``
consecutive hashes the smallest is chosen, the rightmost of equal ones. The
chosen hashes with their positions are the fingerprint. Two texts that share a
passage of ``w + k - 1`` code points (25 as set) share a chosen hash, and none
is chosen because of passages shorter than ``k``. An edited text, as below,
shares its first half, so a hash is shared from 49 code points on. A text with fewer than ``k`` code
points has one hash, of the whole text; with fewer than ``w`` hashes, the
smallest is chosen. An empty or null text has an empty fingerprint.

``likeness`` of two fingerprints: size of the intersection over size of the
union of their hash sets, 1 for two empty ones.

The query also fingerprints an edited text: the second half of the text is
replaced by the start of the next document, in descending ``doc_id``. That
neighbour is found without a global sort: rows go to ranges of ``doc_id``
(bounds from approximate percentiles), each range is sorted on its own, and
the first row of a range is also sent to the range before it. Rows of equal
``doc_id`` are ordered by text, null ids come last.

Defined results: null and empty texts have empty fingerprints and a length of 0; ids
must be numbers; rows of one id, repeated rows included, are documents of their
own, one after the other; a single document is its own successor; a very long text
is hashed as a whole in its task; an empty table
gives no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import arrow_limits, documents
from ledgerline.llm.words import mix, window_hashes

K = 10
W = 16
_U = np.uint64
_LOW = _U(0xFFFFFFFF)
_HIGH = _U(0xFFFFFFFF00000000)


def winnow(text: str | None, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): chosen k-grams of the text, in order of position."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.empty(0, np.int64), np.empty(0, np.uint32)
    grams = window_hashes(mix(points.astype(_U)), min(k, len(points)))
    n, w = len(grams), min(w, len(grams))
    # hash above, distance from the end below: the least one is the smallest
    # hash, and of equal hashes the rightmost
    keyed = (grams & _HIGH) | (_LOW - np.arange(n, dtype=_U) % _LOW)
    low, width = keyed, 1
    while 2 * width <= w:  # minimum over runs, by doubling
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[:len(low) - (w - width)], low[w - width:])
    chosen = low[np.concatenate(([True], low[1:] != low[:-1]))]
    return (_LOW - (chosen & _LOW)).astype(np.int64), (chosen >> _U(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def encode(hashes: np.ndarray) -> str:
    """The chosen hashes in order, eight hexadecimal digits each."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = K, w: int = W) -> DataFrame:
    """``docs`` rows as (``doc_id``, ``hashes``, ``positions``): the general
    form, one row per document."""
    arrow_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("hashes", T.ArrayType(T.LongType())),
                           T.StructField("positions", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [winnow(t, k, w) for t in b.column(1).to_pylist()]
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h.astype(np.int64) for _, h in found], kind),
                 pa.array([p for p, _ in found], kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def with_next(docs: DataFrame, id_col: str, text_col: str, ranges: int | None = None) -> DataFrame:
    """(range_no, place, doc_id, text) in descending ``doc_id`` within each
    range, partitioned by range; the last row of a range has ``place`` 1 and
    repeats the row that comes next."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("string").alias("text"))
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", steps, 10 * n)).first()[0] if steps else []
    bounds = sorted(set(bounds or []))
    # range 0 holds the largest ids; null ids are the smallest
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds])
    number = F.coalesce(F.size(F.filter(cuts, lambda c: c >= F.col("doc_id"))), F.lit(len(bounds)))
    number = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(number)
    ids = rows.select("doc_id", number.alias("range_no"))
    # one row per range, and at most as many ranges as asked for
    tops = ids.groupBy("range_no").agg(F.max("doc_id").alias("top"))
    ring = Window.orderBy("range_no")
    prior = tops.select("range_no", "top", F.coalesce(
        F.lag("range_no").over(ring), F.max("range_no").over(ring.rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing))).alias("prior"))
    placed = rows.withColumn("range_no", number).join(F.broadcast(prior), "range_no")
    own = F.struct(F.col("range_no"), F.lit(0).alias("place"))
    ahead = F.struct(F.col("prior").alias("range_no"), F.lit(1).alias("place"))
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, ahead)) \
              .otherwise(F.array(own))
    spread = placed.select(F.explode(copies).alias("at"), "doc_id", "text") \
                   .select("at.range_no", "at.place", "doc_id", "text")
    return spread.repartition(n, "range_no").sortWithinPartitions(
        "range_no", "place", F.col("doc_id").desc_nulls_last(), "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                        k: int = K, w: int = W) -> DataFrame:
    """The rows of ``op10_winnowing`` for any table of texts."""
    arrow_limits(docs.sparkSession)
    rows = with_next(docs, id_col, text_col)
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
        T.StructField("positions", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # the row whose successor hasn't come yet
        for b in batches:
            out = []
            for number, place, key, text in zip(*(c.to_pylist() for c in b.columns)):
                text = text or ""
                marks = winnow(text, k, w)
                if waiting and waiting[0] == number and not waiting[1]:
                    _, _, old, before, (at, mine) = waiting
                    half = len(before) // 2
                    edited = before[:len(before) - half] + text[:half]
                    theirs = winnow(edited, k, w)[1]
                    out.append((old, len(before),
                                hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                                encode(mine), encode(theirs), likeness(mine, theirs),
                                likeness(mine, marks[1]), at.astype(np.int32)))
                # a second row sent ahead has no successor here
                waiting = (number, place, key, text, marks)
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
