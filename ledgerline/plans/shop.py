"""Commerce analytics on the driver tables.

Stand-ins: customer = shop customer (state = c_nationkey), orders = orders
(delivered = status 'F', purchase time = o_orderdate, payment =
o_totalprice), lineitem = order items (product = l_partkey, seller =
l_suppkey, price = l_extendedprice, freight = l_quantity), part = product
(category = p_type), supplier = seller (state = s_nationkey).
Money is summed as DECIMAL(18,2) (exact, order independent) and reported
as DOUBLE.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.fixed_values import TIER_LABELS
from ledgerline.functions.dates import day_start, month_start
from ledgerline.functions.numeric import money
from ledgerline.operators import commerce, ordering, ranking, timeseries
from ledgerline.sources.tables import load

def delivered():
    return F.col("o_orderstatus") == "F"


def _dbl(c):
    return F.col(c).cast("double") if isinstance(c, str) else c.cast("double")


def delivered_payments(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").filter(delivered())


def never_purchased(spark: SparkSession, sf: str) -> DataFrame:
    """Customers without any '1-URGENT' order (anti join)."""
    c = load(spark, sf, "customer")
    urgent = load(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    out = c.join(urgent, c.c_custkey == urgent.o_custkey, "left_anti")
    return out.select(F.col("c_custkey").alias("customer_id"), "c_name",
                      F.col("c_mktsegment").alias("customer_city"),
                      F.col("c_nationkey").alias("customer_state"))


def payment_mismatch(spark, sf) -> DataFrame:
    li = load(spark, sf, "lineitem")
    bill = li.groupBy(F.col("l_orderkey").alias("order_id")).agg(
        F.sum(money("l_extendedprice") + money("l_quantity")).alias("total_bill"))
    paid = load(spark, sf, "orders").groupBy(F.col("o_orderkey").alias("order_id")).agg(
        F.sum(money("o_totalprice")).alias("total_paid"))
    out = commerce.reconcile_amounts(bill, paid, "order_id", "total_bill", "total_paid", 1)
    out = ordering.present(out, ordering.key(F.abs(F.col("total_bill") - F.col("total_paid")),
                                             descending=True))
    return out.select("order_id", _dbl("total_bill").alias("total_bill"),
                      _dbl("total_paid").alias("total_paid"))


def monthly_delivered_revenue(spark, sf) -> DataFrame:
    o = delivered_payments(spark, sf)
    return o.groupBy(month_start("o_orderdate").alias("month")).agg(
        _dbl(F.sum(money("o_totalprice"))).alias("revenue"))


def mom_growth(spark, sf) -> DataFrame:
    m = monthly_delivered_revenue(spark, sf)
    return timeseries.growth(m, "revenue", "month", prev_name="prev_month_rev",
                             name="mom_growth", digits=2, series=True)


def _product_revenue(spark, sf) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_partkey", "l_extendedprice")
    p = load(spark, sf, "part").select("p_partkey", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.groupBy(F.col("p_partkey").alias("product_id"),
                     F.col("p_type").alias("category")).agg(
        F.sum(money("l_extendedprice")).alias("revenue"))


def top_products_per_category(spark, sf) -> DataFrame:
    pr = _product_revenue(spark, sf)
    pr = ranking.add_rank(pr, "category", F.col("revenue").desc(), "ranked", "rank")
    out = ranking.top_k(pr, "category", F.col("revenue").desc(), 10, "dense_ranked")
    return out.withColumn("revenue", _dbl("revenue"))


def second_highest_per_category(spark, sf) -> DataFrame:
    pr = _product_revenue(spark, sf)
    out = ranking.nth(pr, "category", F.col("revenue").desc(), 2, "ranked")
    return out.withColumn("revenue", _dbl("revenue"))


def customer_spend(spark, sf) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = delivered_payments(spark, sf).select("o_custkey", "o_totalprice")
    j = c.join(o, c.c_custkey == o.o_custkey)
    return j.groupBy(F.col("c_custkey").alias("customer_id"),
                     F.col("c_nationkey").alias("customer_state")).agg(
        F.sum(money("o_totalprice")).alias("clv"))


def clv_tiers(spark, sf) -> DataFrame:
    spend = customer_spend(spark, sf).drop("customer_state")
    out = ranking.tiers(spend, "clv", "customer_id", TIER_LABELS, name="customer_tier")
    return out.select("customer_id", _dbl("clv").alias("clv"), "customer_tier")


def sales_rollup(spark, sf) -> DataFrame:
    o = delivered_payments(spark, sf).select("o_orderdate", money("o_totalprice").alias("pay"))
    out = timeseries.calendar_rollup(o, "o_orderdate", "pay")
    # subtotal rows (NULL levels) after their details, as in the report
    out = ordering.present(out, *[ordering.key(c) for c in ("monthly", "weekly", "daily")])
    return out.withColumn("revenue", _dbl("revenue"))


def seasonal_top_categories(spark, sf) -> DataFrame:
    o = delivered_payments(spark, sf).select("o_orderkey", "o_orderdate")
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    p = load(spark, sf, "part").select("p_partkey", "p_type")
    j = o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey)
    rev = j.groupBy(month_start("o_orderdate").alias("month"),
                    F.col("p_type").alias("category")).agg(
        F.sum(money("l_extendedprice")).alias("revenue"))
    out = ranking.top_k(rev, "month", F.col("revenue").desc(), 3, "ranking")
    return out.withColumn("revenue", _dbl("revenue"))


def customer_360(spark, sf, dedupe: bool = False, second_review: bool = False) -> DataFrame:
    """Six-table view. One review per order (score = leading digit of the
    order priority), or with ``second_review`` another one, of score 1, for delivered
    orders; as in the recipe, item-level aggregates are computed
    over the joined rows (``dedupe=True`` aggregates per order first)."""
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name")
    cust = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_nationkey").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"), F.col("n_name").alias("customer_state"))
    o = load(spark, sf, "orders")
    orders = o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
                      F.col("o_orderdate").alias("purchased_at"))
    reviews = o.select(F.col("o_orderkey").alias("order_id"),
                       F.substring("o_orderpriority", 1, 1).cast("int").alias("review_score"))
    if second_review:
        reviews = reviews.unionByName(o.filter(delivered()).select(
            F.col("o_orderkey").alias("order_id"), F.lit(1).alias("review_score")))
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                            "l_extendedprice", "l_quantity")
    p = load(spark, sf, "part").select("p_partkey")
    s = load(spark, sf, "supplier").select("s_suppkey")
    items = (li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
               .select(F.col("l_orderkey").alias("order_id"),
                       money("l_extendedprice").alias("price"), money("l_quantity").alias("freight")))
    keys = ["customer_zip_code_prefix", "customer_city", "customer_state"]
    return commerce.customer_view(cust, orders, items, reviews, keys, dedupe)


def _delivered_brand_lines(spark, sf) -> DataFrame:
    o = delivered_payments(spark, sf).select("o_orderkey", "o_custkey")
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = load(spark, sf, "part").select("p_partkey", "p_brand")
    return o.join(li, o.o_orderkey == li.l_orderkey).join(p, li.l_partkey == p.p_partkey)


BRANDS_A = ("Brand#1",)
BRANDS_B = ("Brand#2", "Brand#3", "Brand#4")


def bought_a_not_b(spark, sf) -> DataFrame:
    j = _delivered_brand_lines(spark, sf)
    out = commerce.in_a_not_b(j, "o_custkey", F.col("p_brand").isin(*BRANDS_A),
                              F.col("p_brand").isin(*BRANDS_B))
    return out.select(F.col("o_custkey").alias("customer_id"))


def best_seller_per_seller_category(spark, sf) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice")
    p = load(spark, sf, "part").select("p_partkey", "p_type")
    j = li.join(p, li.l_partkey == p.p_partkey).filter(F.col("p_type").isNotNull())
    rev = j.groupBy(F.col("l_suppkey").alias("seller_id"), F.col("p_partkey").alias("product_id"),
                    F.col("p_type").alias("category")).agg(
        F.sum(money("l_extendedprice")).alias("revenue"))
    out = ranking.top_k(rev, ["seller_id", "category"], F.col("revenue").desc(), 1,
                        "top_product", method="row_number", tiebreak=[F.col("product_id").asc()])
    return out.withColumn("revenue", _dbl("revenue"))


def bought_together(spark, sf) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    return commerce.pair_counts(li, "l_orderkey", "l_partkey",
                                names=("product_1", "product_2"),
                                out="bought_together_count")


ESTIMATE_DAYS = 30


def late_deliveries(spark, sf) -> DataFrame:
    """Items shipped more than 24 h after the estimate (order date + 30 days)."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate")
    s = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    j = (li.join(s, li.l_suppkey == s.s_suppkey)
           .join(o, o.o_orderkey == li.l_orderkey)
           .join(c, o.o_custkey == c.c_custkey)
           .withColumn("estimated_delivery",
                       F.col("o_orderdate") + F.make_dt_interval(F.lit(ESTIMATE_DAYS))))
    late = commerce.late_events(j, "l_shipdate", "estimated_delivery", 24 * 3600)
    return late.select(F.col("o_orderkey").alias("order_id"),
                       F.col("s_suppkey").alias("seller_id"),
                       F.col("c_custkey").alias("customer_id"),
                       F.lpad(F.col("s_nationkey").cast("string"), 5, "0").alias("seller_zip_code_prefix"),
                       F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("customer_zip_code_prefix"),
                       F.col("s_nationkey").alias("seller_state"),
                       F.col("c_nationkey").alias("customer_state"),
                       "estimated_delivery", F.col("l_shipdate").alias("delivered_at"),
                       "delay_seconds")


def above_state_average(spark, sf) -> DataFrame:
    out = commerce.above_group_average(customer_spend(spark, sf), "clv", ["customer_state"], "state_avg", digits=2)
    return out.select("customer_id", "customer_state", _dbl("clv").alias("total_spent"),
                      _dbl("state_avg").alias("state_avg"))


def consecutive_month_streaks(spark, sf, distinct_months: bool = False) -> DataFrame:
    o = delivered_payments(spark, sf).select("o_custkey", "o_orderdate")
    out = timeseries.streaks(o, "o_custkey", "o_orderdate", 3, distinct_months)
    return out.withColumnRenamed("o_custkey", "customer_id")


def moving_average_7(spark, sf) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderdate")
    daily = o.groupBy(day_start("o_orderdate").alias("order_date")).agg(
        F.count(F.lit(1)).alias("total_orders"))
    return timeseries.moving_average(daily, "total_orders", "order_date", 7,
                                     "weekly_moving_avg", 2, series=True)


def order_gaps(spark, sf) -> DataFrame:
    o = load(spark, sf, "orders").select(F.col("o_custkey").alias("customer_id"),
                                         F.col("o_orderkey").alias("order_id"),
                                         F.col("o_orderdate").alias("order_purchase_timestamp"))
    return timeseries.gap(o, "customer_id", "order_purchase_timestamp", "order_id",
                          prev_name="prev_order", gap_name="order_gap_seconds")


def top_sellers_per_state(spark, sf) -> DataFrame:
    s = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    li = load(spark, sf, "lineitem").select("l_suppkey", "l_extendedprice")
    rev = s.join(li, s.s_suppkey == li.l_suppkey).groupBy(
        F.col("s_suppkey").alias("seller_id"), F.col("s_nationkey").alias("seller_state")).agg(
        F.sum(money("l_extendedprice")).alias("revenue"))
    out = ranking.top_k(rev, "seller_state", F.col("revenue").desc(), 3, "seller_ranking")
    return out.withColumn("revenue", _dbl("revenue"))


def running_revenue_pct(spark, sf) -> DataFrame:
    o = delivered_payments(spark, sf).select("o_orderkey", "o_orderdate")
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    daily = li.join(o, o.o_orderkey == li.l_orderkey).groupBy(
        day_start("o_orderdate").alias("order_date")).agg(
        F.sum(money("l_extendedprice")).alias("revenue"))
    out = timeseries.share_of_total(daily, "revenue", "order_date", series=True)
    return out.select("order_date", _dbl("revenue").alias("revenue"),
                      _dbl("running_total").alias("running_total"), "grand_total_percentage")


def running_line_revenue(spark, sf) -> DataFrame:
    """Running revenue by shipping date over the raw lines of each return
    flag; a flag holds half of all lines."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate",
                                            money("l_extendedprice").alias("revenue"))
    out = timeseries.running_total(li, "revenue", "l_shipdate", by=["l_returnflag"])
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate",
                      _dbl("running_total").alias("running_total"))


def moving_order_value(spark, sf) -> DataFrame:
    """Mean value of an order and the six before it, and the growth over the
    previous one, over all orders."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate", money("o_totalprice").alias("value"))
    order = ["o_orderdate", "o_orderkey"]
    out = timeseries.moving_average(o, "value", order, 7, "moving_avg", 2)
    out = timeseries.growth(out.withColumn("value", _dbl("value")), "value", order, "prev_value", "growth_pct", 2)
    return out.select("o_orderkey", *[_dbl(c).alias(c) for c in ("value", "moving_avg", "prev_value", "growth_pct")])


def dynamic_discount(spark, sf) -> DataFrame:
    """Every order is a discount request: value = total / 1000
    (kept exact as DECIMAL)."""
    o = load(spark, sf, "orders")
    req = o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        (money("o_totalprice") * F.lit(Decimal("0.001"))).alias("order_value"))
    hist = o.select(F.col("o_custkey").alias("customer_id"), "o_orderstatus")
    out = commerce.discount(req, hist, "customer_id", "order_value", delivered())
    return out.select("order_id", "customer_id", _dbl("order_value").alias("order_value"),
                      "delivered_orders", "discount_percent",
                      _dbl("final_amount").alias("final_amount"))


def sales_cube(spark, sf):
    o = delivered_payments(spark, sf).select("o_orderdate", "o_orderpriority",
                                             money("o_totalprice").alias("pay"))
    out = timeseries.cube_report(o, {"monthly": month_start("o_orderdate"),
                                     "priority": F.col("o_orderpriority")}, "pay")
    return out.withColumn("revenue", _dbl("revenue"))


def clv_percentiles(spark, sf):
    from ledgerline.operators.stats import nearest_rank_percentiles
    spend = customer_spend(spark, sf)
    out = nearest_rank_percentiles(spend, "clv", "customer_id", (25, 50, 75, 90))
    return out.withColumn("value", _dbl("value"))


def line_correlations(spark, sf):
    from ledgerline.operators.stats import correlation_matrix
    li = load(spark, sf, "lineitem")
    return correlation_matrix(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
