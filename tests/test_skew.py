"""Operators on data where one key holds a third of all rows must give the
same answers as their plain (single-task-per-key) formulations."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import seconds_between
from ledgerline.operators import clean, commerce, ordering, timeseries
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(11)
    base = dt.datetime(2020, 1, 1)
    data = []
    for i in range(6000):
        k = 0 if i % 3 == 0 else rnd.randint(1, 300)
        data.append((i, k, base + dt.timedelta(days=rnd.randint(0, 400)),
                     None if rnd.random() < 0.2 else f"v{rnd.randint(0, 5)}", rnd.randint(0, 40)))
    return spark.createDataFrame(data, "id long, k long, t timestamp_ntz, v string, item int")


def test_dedup_first_matches_row_number(spark, hot):
    got = clean.dedup(hot, ["k"], ["t", "id"], "first").select("k", "id")
    w = Window.partitionBy("k").orderBy("t", "id")
    ref = hot.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("k", "id")
    assert rows(got) == rows(ref)


def test_gap_skew_safe_equals_window(spark, hot):
    a = timeseries.gap(hot, "k", "t", "id", "p", "g").select("id", "p", "g")
    w = Window.partitionBy("k").orderBy("t", "id")
    b = hot.withColumn("p", F.lag("t").over(w)).withColumn("g", seconds_between("t", "p")).select("id", "p", "g")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_fill_from_group_matches_window_reference(spark, hot):
    got = clean.fill_from_group(hot, "k", "v", "id", blank_is_null=False).select("id", "v")
    w = Window.partitionBy("k")
    donor = F.min_by(F.when(F.col("v").isNotNull(), F.col("v")),
                     F.when(F.col("v").isNotNull(), F.col("id"))).over(w)
    ref = hot.select("id", F.coalesce("v", donor).alias("v"))
    assert rows(got) == rows(ref)


@pytest.fixture
def split_early(spark):
    """Sort-merge joins only, and partitions that count as skewed when small."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
              "spark.sql.adaptive.coalescePartitions.enabled": "false",
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k",
              "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hot_wide(spark):
    """Half the rows on one key, in several map tasks, which a split needs."""
    k = F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 997).cast("long")
    return spark.range(0, 60000, 1, 8).select(
        "id", k.alias("k"), F.when(F.col("id") % 5 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("v"),
        (F.col("id") % 101).cast("decimal(18,2)").alias("amount"),
        F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("status"))


@pytest.mark.parametrize("case", ["fill", "preview", "average", "discount"])
def test_hot_key_is_split(spark, split_early, case):
    df = _hot_wide(spark)
    out = {"fill": lambda: clean.fill_from_group(df, "k", "v", "id", blank_is_null=False),
           "preview": lambda: clean.donor_preview(df, "k", "v", "id", show=["id"], blank_is_null=False),
           "average": lambda: commerce.above_group_average(df, "amount", ["k"]),
           "discount": lambda: commerce.discount(df.select("id", "k", "amount"), df.select("k", "status"),
                                                 "k", "amount", F.col("status") == "F")}[case]()
    out.collect()
    assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()


def test_streaks_chunked_equals_unchunked(spark, hot):
    a = timeseries.streaks(hot, "k", "t", 2, chunk_rows=7)
    b = timeseries.streaks(hot, "k", "t", 2, chunk_rows=1 << 20)
    assert rows(a) == rows(b)


def test_pair_counts_equal_brute_force(spark, hot):
    baskets = hot.select((F.col("id") % 500).alias("b"), "item")
    got = commerce.pair_counts(baskets, "b", "item", ("a", "c"), "n")
    x, y = baskets.alias("x"), baskets.alias("y")
    ref = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.item") < F.col("y.item"))) \
           .groupBy(F.col("x.item").alias("a"), F.col("y.item").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_rows_of_one_sort_value_are_split_between_range_partitions(spark):
    """Most pairs are bought together once: their order by count isn't one task."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # no merging of small partitions
    try:
        df = spark.range(0, 40000, 1, 8).select("id", F.when(F.col("id") % 100 == 0, 2).otherwise(1).alias("n"),
                                                F.create_map(F.lit("k"), "id").alias("m"))
        got = ordering.present(df, ordering.key("n", descending=True)).rdd.map(lambda r: (r.n, r.id)).glom().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    flat = [x for part in got for x in part]
    assert sorted(flat) == sorted((2 if i % 100 == 0 else 1, i) for i in range(40000))
    assert [n for n, _ in flat] == sorted((n for n, _ in flat), reverse=True)
    assert max(map(len, got)) < 12000


def test_columns_of_one_name_are_no_tie_break(spark):
    df = spark.range(3).select("id", F.lit(1).alias("a"), F.lit(2).alias("A"))
    assert [r[0] for r in ordering.present(df, ordering.key("id", descending=True)).collect()] == [2, 1, 0]
