import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import epidemic, explore, setops, stats, timeseries
from ledgerline.sources import files, schemas
from tests.conftest import rows

D = dt.datetime
FACTS = ("continent string, location string, date timestamp_ntz, population bigint, "
         "new_cases double, total_cases double, new_deaths string, total_deaths string")


def _facts(spark):
    return spark.createDataFrame([
        ("Europe", "A", D(2020, 1, 1), 100, 1.0, 1.0, "0", None),      # NULL deaths -> 0
        ("Europe", "A", D(2020, 1, 2), 100, 0.0, 0.0, "1", "1"),       # zero cases -> NULL
        ("Europe", "A", D(2020, 1, 3), 100, 4.0, 4.0, "1", "2"),
        (None, "World", D(2020, 1, 3), 1000, 4.0, 4.0, "1", "2"),
        (None, "Europe", D(2020, 1, 3), 500, 4.0, 4.0, "3", "2"),
        (None, "International", D(2020, 1, 3), 5, 1.0, 1.0, "7", "7"),
    ], FACTS)


def test_death_pct_and_infection(spark):
    out = rows(epidemic.death_pct_daily(_facts(spark)), "date", "death_percentage")
    assert out == [(D(2020, 1, 1), 0.0), (D(2020, 1, 2), None), (D(2020, 1, 3), 50.0)]
    inf = rows(epidemic.infection_rate_daily(_facts(spark)), "date", "infection_rate")
    assert inf[-1] == (D(2020, 1, 3), 4.0)


def test_aggregate_locations_and_fatality(spark):
    agg = rows(epidemic.deaths_by_aggregate_location(_facts(spark)))
    assert agg == [("Europe", 3)]
    g = epidemic.global_fatality(_facts(spark)).first()
    assert (g["total_cases"], g["total_deaths"], g["death_percentage"]) == (5.0, 2, 40.0)
    assert rows(epidemic.peak_by_continent(_facts(spark))) == [("Europe", 4.0)]


def test_rolling_vaccinations_peers_and_typed_table(spark):
    f = _facts(spark)
    v = spark.createDataFrame([("A", D(2020, 1, 1), "2", 2.0), ("A", D(2020, 1, 3), "3", 5.0),
                               ("World", D(2020, 1, 3), "10", 10.0)],
                              "location string, date timestamp_ntz, new_vaccinations string, "
                              "total_vaccinations double")
    r = rows(epidemic.rolling_vaccinations(f, v), "location", "date", "rolling_people_vaccinated")
    assert r == [("A", D(2020, 1, 1), 2.0), ("A", D(2020, 1, 3), 5.0)]   # countries only
    t = epidemic.pct_vaccinated_table(f, v)
    assert {x["location"] for x in t.collect()} == {"A", "World"}     # no continent filter
    assert dict(rows(t, "location", "percent_people_vaccinated"))["World"] == 1.0


def test_explore(spark):
    df = spark.createDataFrame([("a", 10, "1", dt.date(2022, 3, 1)), ("a", 5, "0.5", dt.date(2023, 1, 1)),
                                ("b", 7, "1.0", dt.date(2023, 2, 1)), ("c", 7, "0.9", None)],
                               "company string, n int, pct string, d date")
    m = explore.max_measures(df, ["n", "pct"]).first()
    assert (m["max_n"], m["max_pct"]) == (10, "1.0")            # text max is lexicographic
    assert rows(explore.rows_where_equal(df, "pct", 1), "company") == [("a",), ("b",)]
    r = explore.rolling_total_by_period(df, F.date_format("d", "yyyy"), "n")
    assert rows(r) == [("2022", 10, 10), ("2023", 12, 22)]     # NULL period excluded
    top = explore.top_per_period(df, "company", F.year("d"), "n", k=1)
    assert rows(top, "years", "company") == [(2022, "a"), (2023, "b")]


def test_setops(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None)], "k int, m string")
    b = spark.createDataFrame([(2, None), (3, "y")], "k int, m string")
    assert rows(setops.union_distinct([a, b])) == [(1, "x"), (2, None), (3, "y")]
    assert rows(setops.except_distinct(a, b)) == [(1, "x")]
    lk = spark.createDataFrame([("x", 0.1)], "m string, disc double")
    joined = setops.with_lookups(b, [(lk, "m")])
    assert joined.columns == ["m", "k", "disc"]                 # key not repeated
    assert rows(joined, "k", "disc") == [(2, None), (3, None)]  # unmatched keep NULL


def test_share_of_total_and_cube(spark):
    df = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2020, 1, 2), 3.0)], "d timestamp_ntz, v double")
    s = rows(timeseries.share_of_total(df, "v", "d"), "d", "running_total", "grand_total_percentage")
    assert s == [(D(2020, 1, 1), 1.0, 25.0), (D(2020, 1, 2), 4.0, 100.0)]
    c = timeseries.cube_report(df.withColumn("g", F.lit("x")), {"m": F.col("d"), "g": F.col("g")}, "v")
    assert c.count() == 2 * 1 + 2 + 1 + 1     # (m,g), (m), (g), ()


def test_percentiles_and_correlation(spark):
    df = spark.range(1, 11).withColumn("v", F.col("id") * 10)
    p = dict(rows(stats.nearest_rank_percentiles(df, "v", "id", (10, 50, 90, 100))))
    assert p == {10: 10, 50: 50, 90: 90, 100: 100}
    c = stats.correlation_matrix(df.withColumn("w", -F.col("v")), ["v", "w"]).first()
    assert (c["col_a"], c["col_b"], c["corr"]) == ("v", "w", -1.0)


def test_typed_csv_and_catalog(spark):
    d = tempfile.mkdtemp(prefix="ledgerline-csv-")
    with open(os.path.join(d, "h.csv"), "w") as fh:
        fh.write("UniqueID ,ParcelID\n7,p1\n,p2\n")
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("UniqueID", T.IntegerType()), T.StructField("ParcelID", T.StringType())])
    df = files.read_typed_csv(spark, d, schema)
    assert df.columns == ["UniqueID", "ParcelID"] and rows(df) == [(7, "p1"), (None, "p2")]
    other = tempfile.mkdtemp(prefix="ledgerline-csv-")
    with open(os.path.join(other, "h.csv"), "w") as fh:
        fh.write('ParcelID,UniqueID\n"two\nlines, ""q""",8\n')
    assert rows(files.read_typed_csv(spark, other, schema)) == [(8, 'two\nlines, "q"')]
    with pytest.raises(ValueError):
        files.read_typed_csv(spark, other, T.StructType([T.StructField("none", T.StringType())]))
    with open(os.path.join(other, "h.csv"), "a") as fh:
        fh.write("p3,notanumber\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.read_typed_csv(spark, other, schema).collect()
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            files.read_typed_csv(spark, other, schema).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    # without line ends in cells a file is split between tasks
    big = tempfile.mkdtemp(prefix="ledgerline-csv-")
    with open(os.path.join(big, "h.csv"), "w") as fh:
        fh.write("UniqueID,ParcelID\n" + "".join(f"{i},p{i}\n" for i in range(20000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        whole, split = (files.read_typed_csv(spark, big, schema, multi_line=m) for m in (True, False))
        assert whole.rdd.getNumPartitions() == 1 < split.rdd.getNumPartitions()
        assert whole.exceptAll(split).count() == 0 and split.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    cat = rows(files.schema_catalog(df), "ordinal", "column_name", "data_type")
    assert cat == [(1, "UniqueID", "int"), (2, "ParcelID", "string")]
    conformed = files.conform(spark.createDataFrame([("1", "x")], "a string, b string"), schema)
    assert conformed.dtypes == [("UniqueID", "int"), ("ParcelID", "string")]
    assert files.empty_clone(df).count() == 0 and files.empty_clone(df).schema == df.schema
    assert schemas.LAYOFFS["date"].dataType == T.StringType()


def test_hotel_union_with_lookups_fixture(spark):
    schema = "booking_id int, market_segment string, meal string, adr double"
    y2018 = spark.createDataFrame([(1, "Direct", "BB", 10.0), (1, "Direct", "BB", 10.0),
                                   (2, "Groups", None, 5.0)], schema)
    y2019 = spark.createDataFrame([(1, "Direct", "BB", 10.0), (3, "Aviation", "FB", 7.0)], schema)
    seg = spark.createDataFrame([("Direct", 0.1), ("Groups", 0.2)], "market_segment string, discount double")
    meal = spark.createDataFrame([("BB", 12.0)], "meal string, cost double")
    out = setops.union_with_lookups([y2018, y2019], [(seg, "market_segment"), (meal, "meal")])
    got = rows(out, "booking_id", "discount", "cost")
    # identical booking inside one year and across years kept once; segment and
    # meal absent from the lookups and a NULL meal keep NULL lookup values
    assert got == [(1, 0.1, 12.0), (2, 0.2, None), (3, None, None)]


def test_rolling_vaccinations_null_values(spark):
    f = _facts(spark)
    v = spark.createDataFrame([("A", D(2020, 1, 1), None, None), ("A", D(2020, 1, 2), "4", 4.0),
                               ("A", D(2020, 1, 3), None, 4.0)],
                              "location string, date timestamp_ntz, new_vaccinations string, "
                              "total_vaccinations double")
    r = rows(epidemic.rolling_vaccinations(f, v), "date", "rolling_people_vaccinated")
    assert r == [(D(2020, 1, 1), None), (D(2020, 1, 2), 4.0), (D(2020, 1, 3), 4.0)]
