"""The distributed numbering must equal single-partition window results,
including a key that holds a third of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import sequence
from ledgerline.operators.sequence import global_row_number, lag_exact, ntile_exact
from tests.conftest import rows


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    data = [(i, 0 if i % 3 == 0 else rnd.randint(1, 50), rnd.randint(0, 20)) for i in range(n)]
    return spark.createDataFrame(data, "id long, k long, v long")


def test_global_row_number_matches_window(spark):
    df = _skewed(spark)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = global_row_number(df, order, "rn", partitions=7).select("id", "rn")
    ref = df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rn"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 100, 1001])
def test_ntile_exact_matches_ntile(spark, n):
    df = spark.range(n).withColumn("v", (F.col("id") * 7919) % 13)
    order = [F.col("v").desc(), F.col("id").asc()]
    got = ntile_exact(df, order, 3, "t", partitions=4).select("id", "t")
    ref = df.select("id", F.ntile(3).over(Window.orderBy(*order)).alias("t"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_lag_exact_matches_lag_with_hot_key(spark):
    df = _skewed(spark)
    order = [F.col("v").asc(), F.col("id").asc()]
    got = lag_exact(df, ["k"], order, {"prev_v": "v", "prev_id": "id"}) \
        .select("id", "prev_v", "prev_id")
    w = Window.partitionBy("k").orderBy(*order)
    ref = df.select("id", F.lag("v").over(w).alias("prev_v"), F.lag("id").over(w).alias("prev_id"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_expand_range_chunks_equal_explode(spark):
    from ledgerline.operators.sequence import expand_range
    df = spark.createDataFrame([("hot", 1, 1000), ("cold", 5, 7), ("empty", 3, 2)],
                               "k string, lo long, hi long")
    got = expand_range(df, F.col("lo"), F.col("hi"), "i", chunk_rows=64, partitions=5)
    ref = df.filter("hi >= lo").withColumn("i", F.explode(F.sequence("lo", "hi")))
    assert got.count() == 1003
    assert got.select("k", "i").exceptAll(ref.select("k", "i")).count() == 0
    assert got.rdd.getNumPartitions() == 5


def test_range_partitions_follow_the_scanned_bytes(spark, tmp_path, monkeypatch):
    spark.range(20000).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert sequence._default_partitions(df) == 8              # small: the session's number
    monkeypatch.setattr(sequence, "PARTITION_BYTES", 1000)
    assert sequence._default_partitions(df) > 8
    assert sequence._default_partitions(spark.createDataFrame([(1,)], "a int")) == 8  # unknown size


def test_staged_tables_have_an_owner_and_go(spark):
    import os
    folder = sequence.staging_folder(spark)
    a, b = (sequence.materialize(spark.range(3), t) for t in ("a", "b"))
    at = [x._ledgerline_path.removeprefix("file:") for x in (a, b)]
    assert all(x._ledgerline_path.startswith(folder) for x in (a, b))
    assert spark.sparkContext.applicationId in folder and a.count() == 3
    sequence.discard(a)
    assert [os.path.exists(x) for x in at] == [False, True] and b.count() == 3


def test_tables_staged_within_a_block_go_with_it(spark):
    import os
    before = sequence.materialize(spark.range(2), "before")
    with sequence.staged_within(spark) as block:
        inner = sequence.materialize(spark.range(3), "inner")
        out = sequence.materialize(inner.selectExpr("id * 2 AS id"), "out")
        block.keep(out)
    there = lambda df: os.path.exists(df._ledgerline_path.removeprefix("file:"))
    assert (there(before), there(inner), there(out)) == (True, False, True)
    assert rows(out) == [(0,), (2,), (4,)] and sequence._scopes == []
    sequence.discard(before, out)
