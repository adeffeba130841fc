"""Namespaces, partition updates, bucketed facts, observed counts, collation,
SQL table functions, sketches and report order."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.sql import register_discount_table
from ledgerline.functions.text import fold_key
from ledgerline.operators import audit, clean, stats
from ledgerline.operators import epidemic as ep
from ledgerline.plans import catalog, epidemic, reports
from ledgerline.sources.files import update_rows
from ledgerline.sources.layers import Layers
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


# -- namespaces ---------------------------------------------------------------
def test_layers_hold_tables_by_qualified_names_and_go_again(spark):
    with Layers(spark, prefix="t1_") as at:
        at.save(spark.range(5), "raw", "things")
        spark.sql(f"CREATE TABLE {at.name('staging', 'things')} USING parquet AS "
                  f"SELECT id * 2 AS id FROM {at.name('raw', 'things')}")
        at.save(at.table("staging", "things").filter("id > 2").withColumn("n", F.lit(1)), "analytics", "things", partition_by=["id"])
        assert rows(spark.table("t1_analytics.things"), "id") == [(4,), (6,), (8,)]
        assert at.table("raw", "things").count() == 5
        at.save(spark.range(5, 7), "raw", "things", mode="append")
        assert at.table("raw", "things").count() == 7
        with pytest.raises(ValueError):
            at.name("gold", "things")
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith("t1_")]


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_bucketed_facts_join_without_exchange(spark, no_broadcast):
    f, v = epidemic.daily_facts(spark, SF), epidemic.daily_vacc(spark, SF)
    want = rows(ep.rolling_vaccinations(f, v))
    with Layers(spark, ["facts"], prefix="t2_") as at:
        f = at.save(f, "facts", "f", bucket_by=["location", "date"], buckets=4)
        v = at.save(v, "facts", "v", bucket_by=["location", "date"], buckets=4)
        joined = ep._joined(f, v, True)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert rows(ep.rolling_vaccinations(f, v)) == want


# -- updates --------------------------------------------------------------------
def _files(path):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns
            for d, _, names in os.walk(path) for x in names if x.endswith(".parquet")}


def test_update_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    data = [(i, i % 4 if i % 4 else None, "a" if i < 9 else "b", float(i)) for i in range(40)]
    spark.createDataFrame(data, "id int, p int, s string, v double").write.partitionBy("p").parquet(path)
    before = _files(path)
    where = F.col("s").eqNullSafe("a") & ((F.col("p") == 1) | F.col("p").isNull())
    assert update_rows(spark, path, ["p"], where, {"s": F.lit("z"), "v": F.col("v") + 1}) == 2
    after = _files(path)
    kept = {f for f in before if after.get(f) == before[f]}
    assert {os.path.basename(os.path.dirname(f)) for f in kept} == {"p=2", "p=3"}
    assert {os.path.basename(os.path.dirname(f)) for f in after if f not in kept} == {"p=1", "p=__HIVE_DEFAULT_PARTITION__"}
    want = [(i, p, "z" if s == "a" and p in (1, None) else s, v + 1 if s == "a" and p in (1, None) else v) for i, p, s, v in data]
    assert rows(spark.read.parquet(path), "id", "p", "s", "v") == sorted(
        want, key=lambda t: tuple((x is None, str(x)) for x in t))


def test_update_of_nothing_and_of_partition_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    before = _files(path)
    assert update_rows(spark, path, ["p"], F.col("id") > 9, {"id": F.lit(0)}) == 0
    assert _files(path) == before
    with pytest.raises(ValueError):
        update_rows(spark, path, ["p"], F.col("id") > 0, {"p": F.lit(0)})


# -- counts beside the work -----------------------------------------------------
def test_observed_counts_need_no_scan_of_their_own(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def touch(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.createDataFrame([(1, None), (2, "b"), (2, "b"), (3, None)], "k int, s string")
    raw = audit.Observed(df.mapInArrow(touch, df.schema), ["s"])
    done = audit.Observed(raw.df.dropDuplicates(), ["k", "s"])
    done.df.write.parquet(str(tmp_path / "t"))
    assert (raw.rows, raw.missing, done.rows, done.missing) == (4, {"s": 2}, 3, {"k": 0, "s": 2})
    assert seen.value == 4


# -- collation ------------------------------------------------------------------
def test_collated_and_folded_comparison_agree(spark):
    words = ["Été", "ete", "ÉTÉ", "eté", "Straße", "strasse", "São Paulo", "sao paulo", "naïve", "NAIVE", None, "", "Z"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, w string")
    distinct = clean.dedup_collated(df.select("w"), ["w"])
    folded = clean.dedup_exact(df.select("w").filter("w NOT IN ('Straße', 'strasse') OR w IS NULL"), fold=("w",))
    key = fold_key("w").alias("k")
    got = [r for r in rows(distinct.filter("lower(w) NOT IN ('straße', 'strasse') OR w IS NULL").select(key), "k")]
    assert got == rows(folded.select(key), "k")
    assert distinct.schema["w"].dataType.simpleString() == "string"
    joined = clean.join_collated(df, distinct.withColumnRenamed("w", "name"), "w", "name")
    assert joined.groupBy("id").count().filter("count <> 1").count() == 0
    assert joined.count() == len(words) - 1  # NULL joins nothing


# -- the discount in SQL --------------------------------------------------------
def test_discount_table_function_for_one_request_and_for_many(spark):
    spark.createDataFrame([(1,)] * 6 + [(2,)], "customer_id long").createOrReplaceTempView("t_history")
    register_discount_table(spark, "t_history", "t_discount", "t_rule")
    one = lambda c, v: tuple(spark.sql(f"SELECT * FROM t_discount({c}, {v})").first())
    assert [float(x) for x in one(9, 100)] == [0, 15, 85]
    assert [float(x) for x in one(2, 600)] == [1, 10, 540]
    assert [float(x) for x in one(1, 100)] == [6, 5, 95]
    assert [float(x) for x in one(2, 100)] == [1, 0, 100]
    spark.createDataFrame([(1, 100), (9, 50), (None, 10)], "c long, v int").createOrReplaceTempView("t_requests")
    many = spark.sql("""SELECT r.c, h.delivered_orders AS n, t.discount_percent AS p FROM t_requests r,
                        LATERAL t_discount_history(r.c) h, LATERAL t_discount_terms(h.delivered_orders, r.v) t""")
    assert rows(many, "c", "n", "p") == [(1, 6, 5), (9, 0, 15), (None, 0, 15)]
    plan = many._jdf.queryExecution().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


# -- sketches -------------------------------------------------------------------
def test_merged_sketches_stay_within_their_error_bound(spark):
    rnd = random.Random(4)
    data = [(i % 60, rnd.lognormvariate(3, 1) if i % 2 else float(i % 50)) for i in range(60000)]
    df = spark.createDataFrame(data, "day int, v double").repartition(16)
    daily = stats.sketches(df, ["day"], "v")
    got = stats.sketch_percentiles(stats.merged(daily.withColumn("m", F.col("day") % 2), ["m"]), (1, 25, 50, 90, 99)).collect()
    assert len(got) == 10
    for r in got:
        values = [v for d, v in data if d % 2 == r.m]
        below, upto = sum(v < r.value for v in values), sum(v <= r.value for v in values)
        want, slack = len(values) * r.percentile / 100, len(values) * stats.RANK_ERROR + 1
        assert r.n == len(values) and below <= want + slack and upto >= want - slack
    assert stats.sketch_percentiles(stats.sketches(df.filter("false"), ["day"], "v"), (50,)).count() == 0


# -- order ----------------------------------------------------------------------
@pytest.mark.parametrize("name", sorted(reports.ORDER))
def test_reports_come_in_their_order(spark, name):
    engine, columns = reports.ORDER[name]
    got = catalog.queries()[name](spark, SF).collect()
    for a, b in zip(got, got[1:]):
        for c in columns:
            down, x, y = c.startswith("-"), a[c.lstrip("-")], b[c.lstrip("-")]
            if x == y:
                continue
            if x is None or y is None:
                null_last = (engine == reports.LARGEST) != down
                assert (y is None) == null_last
            else:
                assert (x > y) if down else (x < y)
            break
