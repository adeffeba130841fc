import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import ranking, timeseries
from tests.conftest import rows

D = dt.datetime


def test_running_total_peers_share(spark):
    df = spark.createDataFrame([("x", D(2020, 1, 1), 1.0), ("x", D(2020, 1, 1), 2.0),
                                ("x", D(2020, 1, 2), 4.0)], "loc string, d timestamp_ntz, v double")
    out = timeseries.running_total(df, "v", "d", by=["loc"], name="r")
    assert sorted(r["r"] for r in out.collect()) == [3.0, 3.0, 7.0]


def test_growth_and_moving_average(spark):
    df = spark.createDataFrame([(D(2020, m, 1), float(v)) for m, v in
                                [(1, 100), (2, 150), (4, 75)]], "m timestamp_ntz, v double")
    g = timeseries.growth(df, "v", "m", "prev", "pct")
    assert rows(g, "m", "prev", "pct") == [(D(2020, 1, 1), None, None),
                                          (D(2020, 2, 1), 100.0, 50.0),
                                          (D(2020, 4, 1), 150.0, -50.0)]  # previous existing month
    ma = timeseries.moving_average(df, "v", "m", rows=2, name="ma")
    assert [r["ma"] for r in ma.orderBy("m").collect()] == [100.0, 125.0, 112.5]


def test_streaks_faithful_vs_distinct(spark):
    rows_ = [("a", D(2020, 1, 5)), ("a", D(2020, 2, 5)), ("a", D(2020, 3, 5)),
             ("b", D(2020, 1, 5)), ("b", D(2020, 2, 5)), ("b", D(2020, 2, 20)),
             ("b", D(2020, 3, 5))]
    df = spark.createDataFrame(rows_, "c string, t timestamp_ntz")
    faithful = timeseries.streaks(df, "c", "t", 3, chunk_rows=1)
    # two orders in February break customer b's streak in the faithful form
    assert rows(faithful, "c", "consecutive_months") == [("a", 3)]
    distinct = timeseries.streaks(df, "c", "t", 3, distinct_months=True)
    assert rows(distinct, "c", "streak_start", "streak_end") == [
        ("a", D(2020, 1, 1), D(2020, 3, 1)), ("b", D(2020, 1, 1), D(2020, 3, 1))]


def test_calendar_rollup_levels(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 1), (D(2020, 1, 2), 2), (D(2020, 2, 3), 4)],
                               "t timestamp_ntz, v int")
    r = timeseries.calendar_rollup(df, "t", "v")
    grand = [x for x in r.collect() if x["monthly"] is None]
    assert len(grand) == 1 and grand[0]["revenue"] == 7 and grand[0]["grouping_level"] == 7
    months = {x["monthly"]: x["revenue"] for x in r.collect() if x["grouping_level"] == 3}
    assert months == {D(2020, 1, 1): 3, D(2020, 2, 1): 4}


def test_gap_first_is_null(spark):
    df = spark.createDataFrame([("c", 1, D(2020, 1, 1)), ("c", 2, D(2020, 1, 3)), ("d", 3, D(2020, 1, 1))],
                               "c string, id int, t timestamp_ntz")
    g = timeseries.gap(df, "c", "t", "id", "prev", "secs")
    assert rows(g, "id", "secs") == [(1, None), (2, 172800), (3, None)]


def test_top_k_ties_and_nth(spark):
    df = spark.createDataFrame([("x", "a", 10), ("x", "b", 10), ("x", "c", 5), ("x", "d", 1),
                                ("y", "e", 3)], "g string, p string, v int")
    top = ranking.top_k(df, "g", F.col("v").desc(), 1, "r")
    assert rows(top, "p") == [("a",), ("b",), ("e",)]     # ties kept
    second = ranking.nth(df, "g", F.col("v").desc(), 2, "r")
    assert rows(second, "p") == [("c",)]                  # dense rank 2
    first = ranking.top_k(df, "g", F.col("v").desc(), 1, "r", "row_number",
                          tiebreak=[F.col("p").asc()])
    assert rows(first, "p") == [("a",), ("e",)]


def test_tiers_distributed_equals_window(spark):
    df = spark.range(50).withColumn("v", F.col("id") % 7)
    a = ranking.tiers(df, "v", "id", ["Gold", "Silver", "Bronze"], "t")
    tile = F.ntile(3).over(Window.orderBy(F.col("v").desc(), "id"))
    b = df.withColumn("t", F.element_at(F.array(*map(F.lit, ["Gold", "Silver", "Bronze"])), tile))
    assert rows(a, "id", "t") == rows(b, "id", "t")


def test_postgres_null_order(spark):
    from ledgerline.operators import ordering
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    asc = [r["v"] for r in ordering.present(df, ordering.key("v")).collect()]
    desc = [r["v"] for r in ordering.present(df, ordering.key("v", descending=True)).collect()]
    assert asc == [1, 3, None] and desc == [None, 3, 1]
