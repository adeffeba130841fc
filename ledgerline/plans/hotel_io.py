"""Hotel bookings union (Q14) and source/sink round trips (S2, S3, S6, S8,
S11, S18).

Hotel stand-in: a booking is an order (arrival = order date, segment =
the customer's market segment, meal = order priority, rate = total
price); the three yearly tables are overlapping year slices, so the
UNION's de-duplication matters. Lookups are derived from the same tables
and each lacks one key.

Round trips write to a fresh folder under the session's checkpoint
directory (the shared folder on a cluster) and read the result back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators import setops
from ledgerline.plans import shop
from ledgerline.operators.sequence import staging_folder
from ledgerline.sources import files
from ledgerline.sources.tables import load

YEAR_SLICES = ((1995, 1996), (1996, 1998), (1998, 2001))


def bookings(spark, sf) -> list[DataFrame]:
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                         "o_orderpriority", "o_totalprice")
    day = F.col("o_orderdate")

    def start(year):
        return F.lit(f"{year}-01-01").cast("timestamp_ntz")

    # half-open ranges of the plain column reach the scan
    return [o.filter((day >= start(lo)) & (day < start(hi + 1))).select(
        F.col("o_orderkey").alias("booking_id"), "o_custkey", day.alias("arrival_date"),
        F.col("o_orderpriority").alias("meal"), F.col("o_totalprice").alias("adr"))
        for lo, hi in YEAR_SLICES]


def union_years_with_lookups(spark, sf):
    c = load(spark, sf, "customer")
    seg = c.select(F.col("c_mktsegment").alias("market_segment")).distinct() \
           .filter(F.col("market_segment") != "HOUSEHOLD") \
           .withColumn("discount", F.length("market_segment") / 100.0)
    o = load(spark, sf, "orders")
    meal = o.select(F.col("o_orderpriority").alias("meal")).distinct() \
            .filter(F.col("meal") != "5-LOW") \
            .withColumn("meal_cost", F.substring("meal", 1, 1).cast("int") * 2.5)
    # united first, so that the customers are joined once
    who = c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("market_segment"))
    booked = setops.union_distinct(bookings(spark, sf)).join(who, "o_custkey").drop("o_custkey")
    return setops.with_lookups(booked, [(seg, "market_segment"), (meal, "meal")])


def _scratch(spark: SparkSession, tag: str) -> str:
    return f"{staging_folder(spark)}/{tag}-{uuid.uuid4().hex}"


CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()), T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType())])


def csv_roundtrip(spark, sf):
    path = _scratch(spark, "csv")
    files.write_extract(load(spark, sf, "customer"), path, fmt="csv")
    return files.read_typed_csv(spark, path, CUSTOMER_SCHEMA, multi_line=False)  # no cell has a line end


def csv_roundtrip_documents(spark, sf):
    """Texts with quotes, separators and line ends."""
    path = _scratch(spark, "csv-texts")
    d = load(spark, sf, "documents").select("doc_id", "text", "lang")
    files.write_extract(d, path, fmt="csv")
    return files.read_typed_csv(spark, path, d.schema)


def extract_roundtrip(spark, sf):
    path = _scratch(spark, "extract")
    files.write_extract(shop.mom_growth(spark, sf), path, fmt="parquet")
    return spark.read.parquet(path)


def append_load(spark, sf):
    """Two positional appends (by segment) into one typed table, read back."""
    path = _scratch(spark, "append")
    c = load(spark, sf, "customer").select(
        "c_custkey", F.trim("c_name"), "c_nationkey", "c_acctbal", F.lower("c_mktsegment"))
    files.append_load(c.filter(F.col("c_mktsegment") < "G"), path, CUSTOMER_SCHEMA)
    files.append_load(c.filter(~F.coalesce(F.col("c_mktsegment") < "G", F.lit(False))), path, CUSTOMER_SCHEMA)
    return spark.read.schema(CUSTOMER_SCHEMA).parquet(path)


QUERIES = {
    "union_years_with_lookups": union_years_with_lookups,
    "csv_roundtrip": csv_roundtrip,
    "csv_roundtrip_documents": csv_roundtrip_documents,
    "extract_roundtrip": extract_roundtrip,
    "append_load": append_load,
}

SQL = {
"union_years_with_lookups": """
WITH b AS (
  SELECT o.o_orderkey AS booking_id, o.o_orderdate AS arrival_date, c.c_mktsegment AS market_segment,
         o.o_orderpriority AS meal, o.o_totalprice AS adr
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey),
u AS (SELECT * FROM b WHERE year(arrival_date) BETWEEN 1995 AND 1996
      UNION SELECT * FROM b WHERE year(arrival_date) BETWEEN 1996 AND 1998
      UNION SELECT * FROM b WHERE year(arrival_date) BETWEEN 1998 AND 2001),
seg AS (SELECT DISTINCT c_mktsegment AS market_segment, length(c_mktsegment) / 100.0 AS discount
        FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'),
meal AS (SELECT DISTINCT o_orderpriority AS meal, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * CAST(2.5 AS DOUBLE) AS meal_cost
         FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT u.*, seg.discount, meal.meal_cost
FROM u LEFT JOIN seg ON u.market_segment = seg.market_segment
LEFT JOIN meal ON u.meal = meal.meal""",
"csv_roundtrip": "SELECT * FROM customer",
"csv_roundtrip_documents": "SELECT doc_id, text, lang FROM documents",
"extract_roundtrip": """
WITH monthly AS (
  SELECT date_trunc('month', o_orderdate) AS month,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
  FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
g AS (SELECT month, revenue, lag(revenue) OVER (ORDER BY month) AS prev_month_rev FROM monthly)
SELECT month, revenue, prev_month_rev,
       round((revenue - prev_month_rev) / prev_month_rev * 100, 2) AS mom_growth
FROM g""",
"append_load": """
SELECT c_custkey, trim(c_name) AS c_name, c_nationkey, c_acctbal, lower(c_mktsegment) AS c_mktsegment
FROM customer""",
}
