"""Rules exposed as Spark SQL functions (U1). SQL functions are inlined
into the plan like any built-in expression (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import SparkSession

DISCOUNT_FUNCTION = """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(prior_orders BIGINT, order_value DECIMAL(20,5))
RETURNS INT
RETURN CASE WHEN coalesce(prior_orders, 0) = 0 THEN 15
            WHEN order_value > 500 THEN 10
            WHEN prior_orders >= 5 THEN 5
            ELSE 0 END
"""


def register_sql_functions(spark: SparkSession, discount_name: str = "dynamic_discount_pct") -> None:
    """Register the one-discount-per-order rule for use in ``spark.sql``."""
    spark.sql(DISCOUNT_FUNCTION.format(name=discount_name))


# the customer's delivered orders, and what follows from their number: apart, since
# Spark can turn the first into one aggregation and one outer join if nothing but
# the customer is passed into it
DISCOUNT_TABLES = ("""
CREATE OR REPLACE TEMPORARY FUNCTION {name}_history(customer BIGINT)
RETURNS TABLE(delivered_orders BIGINT)
RETURN SELECT count(*) FROM {history} h WHERE h.customer_id = customer
""", """
CREATE OR REPLACE TEMPORARY FUNCTION {name}_terms(prior_orders BIGINT, order_value DECIMAL(20,5))
RETURNS TABLE(discount_percent INT, final_amount DECIMAL(38,7))
RETURN SELECT {rule}(prior_orders, order_value),
              CAST(order_value - order_value * {rule}(prior_orders, order_value) / 100 AS DECIMAL(38,7))
""", """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(customer BIGINT, order_value DECIMAL(20,5))
RETURNS TABLE(delivered_orders BIGINT, discount_percent INT, final_amount DECIMAL(38,7))
RETURN SELECT c.n, {rule}(c.n, order_value),
              CAST(order_value - order_value * {rule}(c.n, order_value) / 100 AS DECIMAL(38,7))
       FROM (SELECT count(*) AS n FROM {history} h WHERE h.customer_id = customer) c
""")


def register_discount_table(spark: SparkSession, history: str, name: str = "dynamic_discount",
                            rule: str = "dynamic_discount_pct") -> None:
    """The discount procedure as SQL table functions. One call, for one request:
    ``SELECT * FROM dynamic_discount(42, 600)``. For a table of requests::

        SELECT r.*, h.*, t.* FROM requests r, LATERAL dynamic_discount_history(r.customer_id) h,
               LATERAL dynamic_discount_terms(h.delivered_orders, r.order_value) t

    ``history`` is a table or view with one row (``customer_id``) per delivered
    order."""
    register_sql_functions(spark, rule)
    for sql in DISCOUNT_TABLES:
        spark.sql(sql.format(name=name, rule=rule, history=history))
