"""The rest of the e-commerce staging tables and the audits that run on them
(customers, products and categories are in plans/audits.py).

Stand-ins: orders and line items with padded ids; the approval is text, blank
for pending orders and a day before the purchase for urgent open ones; two
neighbouring orders share a review id, pending orders score 0; instalments
are the order key modulo 4; a geolocation point is a customer, its zip code
the nation key, its coordinates multiples of 1/8 (their sums are exact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import audit
from ledgerline.operators.workflows import stage_shop_tables
from ledgerline.plans.audits import shop_raw
from ledgerline.sources.tables import load


def _padded(col: str):
    return F.concat(F.lit(" "), F.col(col).cast("string"), F.lit(" "))


def raw_orders(spark, sf) -> DataFrame:
    early = (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
    approved = F.when(early, F.expr("o_orderdate - interval 1 day")).otherwise(F.expr("o_orderdate + interval 1 hour"))
    return load(spark, sf, "orders").select(
        _padded("o_orderkey").alias("order_id"), _padded("o_custkey").alias("customer_id"),
        F.concat(F.col("o_orderstatus"), F.lit(" ")).alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" "))
         .otherwise(F.date_format(approved, "yyyy-MM-dd HH:mm:ss")).alias("order_approved_at"))


def raw_order_items(spark, sf) -> DataFrame:
    return load(spark, sf, "lineitem").select(
        _padded("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("order_item_id"),
        _padded("l_partkey").alias("product_id"), _padded("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"), F.col("l_extendedprice").alias("price"),
        (F.col("l_quantity") - 1).alias("freight_value"))


def raw_reviews(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select(
        F.concat(F.lit(" r"), F.floor(F.col("o_orderkey") / 2).cast("string")).alias("review_id"),
        _padded("o_orderkey").alias("order_id"),
        F.when(F.col("o_orderstatus") == "P", 0)
         .otherwise(F.substring("o_orderpriority", 1, 1).cast("int")).alias("review_score"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(" ")).otherwise(F.col("o_orderpriority"))
         .alias("review_comment_title"),
        F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.lit(" fine ")).alias("review_comment_message"),
        F.col("o_orderdate").alias("review_creation_date"), F.col("o_orderkey").alias("load_no"))


def raw_payments(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").select(
        _padded("o_orderkey").alias("order_id"), F.lit(1).alias("payment_sequential"),
        F.concat(F.lit(" "), "o_orderpriority").alias("payment_type"),
        (F.col("o_orderkey") % 4).cast("int").alias("payment_installments"),
        F.col("o_totalprice").alias("payment_value"))


def raw_sellers(spark, sf) -> DataFrame:
    s = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        _padded("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("seller_zip_code_prefix"),
        F.concat(F.col("n_name"), F.lit(" ")).alias("seller_city"),
        F.substring("n_name", 1, 2).alias("seller_state"))


def raw_geolocation(spark, sf) -> DataFrame:
    whole = F.floor(F.col("c_acctbal")).cast("double")
    return load(spark, sf, "customer").select(
        F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
        (whole / 4).alias("geolocation_lat"), (whole / -8).alias("geolocation_lng"),
        F.concat(F.lit(" São "), "c_mktsegment").alias("geolocation_city"),
        F.substring("c_mktsegment", 1, 2).alias("geolocation_state"))


RAW = {"orders": raw_orders, "order_items": raw_order_items, "reviews": raw_reviews,
       "payments": raw_payments, "sellers": raw_sellers, "geolocation": raw_geolocation}


def staged(spark, sf, table: str) -> DataFrame:
    return stage_shop_tables({table: RAW[table](spark, sf)}, review_order="load_no")[table]


def _staging(table: str):
    def q(spark, sf):
        return staged(spark, sf, table)
    return q


def staging_reconcile(spark, sf):
    """Reviews before and after staging."""
    return audit.reconcile_counts(raw_reviews(spark, sf), staged(spark, sf, "reviews"))


def invalid_orders(spark, sf):
    rules = {"approved_before_purchase": F.col("order_approved_at") < F.col("order_purchase_timestamp"),
             "not_approved": F.col("order_approved_at").isNull()}
    return audit.violations(staged(spark, sf, "orders"), rules, ["order_id"])


def invalid_order_items(spark, sf):
    rules = {"price_not_positive": F.col("price") <= 0, "freight_not_positive": F.col("freight_value") <= 0}
    return audit.violations(staged(spark, sf, "order_items"), rules, ["order_id", "order_item_id"])


def invalid_reviews(spark, sf):
    rules = {"score_out_of_range": ~F.col("review_score").between(1, 5)}
    return audit.violations(staged(spark, sf, "reviews"), rules, ["review_id", "review_score"])


def invalid_payments(spark, sf):
    rules = {"no_instalments": F.col("payment_installments").isNull()}
    return audit.violations(staged(spark, sf, "payments"), rules, ["order_id", "payment_sequential"])


def orders_without_customer(spark, sf):
    """Orders whose customer id went with the customers' de-duplication."""
    customers = stage_shop_tables({"customers": shop_raw(spark, sf)["customers"]})["customers"]
    return audit.orphans(staged(spark, sf, "orders"), customers, "customer_id") \
                .select("order_id", "customer_id", "order_status")


QUERIES = {**{f"staging_{t}": _staging(t) for t in RAW},
           "staging_reconcile": staging_reconcile,
           "invalid_orders": invalid_orders,
           "invalid_order_items": invalid_order_items,
           "invalid_reviews": invalid_reviews,
           "invalid_payments": invalid_payments,
           "orders_without_customer": orders_without_customer}

SQL = {
"staging_orders": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       lower(o_orderstatus) AS order_status, o_orderdate AS order_purchase_timestamp,
       date_trunc('second', CASE WHEN o_orderstatus = 'P' THEN NULL
            WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_orderdate - INTERVAL 1 DAY
            ELSE o_orderdate + INTERVAL 1 HOUR END) AS order_approved_at
FROM orders""",
"staging_order_items": """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id,
       CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id,
       l_shipdate AS shipping_limit_date, l_extendedprice AS price, l_quantity - 1 AS freight_value
FROM lineitem""",
"staging_reviews": """
SELECT 'r' || CAST(o_orderkey // 2 AS VARCHAR) AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id,
       CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(o_orderpriority[1] AS INTEGER) END AS review_score,
       NULLIF(o_orderpriority, '5-LOW') AS review_comment_title,
       CASE WHEN o_orderstatus <> 'O' THEN 'fine' END AS review_comment_message,
       o_orderdate AS review_creation_date, o_orderkey AS load_no
FROM orders WHERE o_orderkey IN (SELECT MAX(o_orderkey) FROM orders GROUP BY o_orderkey // 2)""",
"staging_payments": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 1 AS payment_sequential,
       lower(o_orderpriority) AS payment_type,
       CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 4 AS INTEGER) END AS payment_installments,
       o_totalprice AS payment_value
FROM orders""",
"staging_sellers": """
SELECT CAST(s_suppkey AS VARCHAR) AS seller_id,
       right('0000' || CAST(s_nationkey AS VARCHAR), 5) AS seller_zip_code_prefix,
       lower(n_name) AS seller_city, left(n_name, 2) AS seller_state
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
"staging_geolocation": """
SELECT right('0000' || CAST(c_nationkey AS VARCHAR), 5) AS geolocation_zip_code_prefix,
       SUM(floor(c_acctbal)) / 4 / COUNT(*) AS latitude, -SUM(floor(c_acctbal)) / 8 / COUNT(*) AS longitude,
       'sao ' || lower(MAX(c_mktsegment)) AS city, MAX(left(c_mktsegment, 2)) AS state
FROM customer GROUP BY c_nationkey""",
"staging_reconcile": """
SELECT COUNT(*) AS before_rows, COUNT(DISTINCT o_orderkey // 2) AS after_rows,
       COUNT(*) - COUNT(DISTINCT o_orderkey // 2) AS removed_rows FROM orders""",
"invalid_orders": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CASE WHEN o_orderstatus = 'P' THEN 'not_approved'
       ELSE 'approved_before_purchase' END AS rule
FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')""",
"invalid_order_items": """
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id, 'price_not_positive' AS rule
FROM lineitem WHERE l_extendedprice <= 0
UNION ALL
SELECT CAST(l_orderkey AS VARCHAR), l_linenumber, 'freight_not_positive' FROM lineitem WHERE l_quantity <= 1""",
"invalid_reviews": """
WITH latest AS (SELECT arg_max(o_orderstatus, o_orderkey) AS status, o_orderkey // 2 AS k FROM orders GROUP BY k)
SELECT 'r' || CAST(k AS VARCHAR) AS review_id, 0 AS review_score, 'score_out_of_range' AS rule
FROM latest WHERE status = 'P'""",
"invalid_payments": """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 1 AS payment_sequential, 'no_instalments' AS rule
FROM orders WHERE o_orderkey % 4 = 0""",
"orders_without_customer": """
WITH kept AS (SELECT MAX(CAST(c_custkey AS VARCHAR)) AS id FROM customer
              GROUP BY lower(c_mktsegment), c_nationkey)
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
       lower(o_orderstatus) AS order_status
FROM orders WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT id FROM kept)""",
}
