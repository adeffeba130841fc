import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import commerce
from tests.conftest import rows


def test_pair_counts_duplicate_lines_multiply(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (1, "b"), (2, "a"),
                                (2, "c"), (3, "a")], "o int, p string")
    out = commerce.pair_counts(df, "o", "p", ("p1", "p2"), "n")
    assert rows(out) == [("a", "b", 6), ("a", "c", 1)]


def test_in_a_not_b(spark):
    df = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (3, "B"), (4, None)], "c int, cat string")
    out = commerce.in_a_not_b(df, "c", F.col("cat") == "A", F.col("cat") == "B")
    assert rows(out) == [(2,)]


def test_reconcile_tolerance(spark):
    bill = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 10.0)], "k int, b double")
    paid = spark.createDataFrame([(1, 9.01), (2, 9.0), (3, 8.99)], "k int, p double")
    out = commerce.reconcile_amounts(bill, paid, "k", "b", "p", 1.0)
    assert rows(out, "k") == [(3,)]


def test_late_events_strict(spark):
    base = dt.datetime(2020, 1, 1)
    df = spark.createDataFrame([(1, base + dt.timedelta(hours=24), base),
                                (2, base + dt.timedelta(hours=24, seconds=1), base)],
                               "id int, a timestamp_ntz, e timestamp_ntz")
    assert rows(commerce.late_events(df, "a", "e"), "id") == [(2,)]


def test_discount_branches(spark):
    hist = spark.createDataFrame([("c5", "delivered")] * 5 + [("c1", "delivered"), ("c0", "canceled")],
                                 "c string, s string")
    req = spark.createDataFrame([("new", 10.0), ("c5", 520.0), ("c5", 67.0), ("c1", 67.0), ("c0", 67.0)],
                                "c string, v double")
    out = commerce.discount(req, hist, "c", "v", F.col("s") == "delivered")
    got = rows(out, "c", "v", "discount_percent", "final_amount")
    assert got == [("c0", 67.0, 15, 56.95), ("c1", 67.0, 0, 67.0), ("c5", 520.0, 10, 468.0),
                   ("c5", 67.0, 5, 63.65), ("new", 10.0, 15, 8.5)]


def test_above_group_average(spark):
    df = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 20.0), ("s", 3, 30.0), ("t", 4, 5.0)],
                               "st string, c int, v double")
    assert rows(commerce.above_group_average(df, "v", ["st"]), "c") == [(3,)]


def test_discount_sql_function(spark):
    from ledgerline.functions.sql import register_sql_functions
    register_sql_functions(spark)
    got = spark.sql("SELECT dynamic_discount_pct(0, 10) a, dynamic_discount_pct(3, 520) b, "
                    "dynamic_discount_pct(7, 67) c, dynamic_discount_pct(2, 67) d").first()
    assert tuple(got) == (15, 10, 5, 0)


def test_schemas_declared():
    from ledgerline.sources import schemas
    assert [f.name for f in schemas.ORDER_ITEMS.fields][:3] == ["order_id", "order_item_id", "product_id"]
    assert schemas.PAYMENTS["payment_value"].dataType.simpleString() == "decimal(10,2)"
    assert len(schemas.CREDIT.fields) == 17


def test_customer_view_fan_out_and_dedupe(spark):
    cust = spark.createDataFrame([(1, "SP")], "customer_id int, state string")
    orders = spark.createDataFrame([(10, 1, dt.datetime(2020, 1, 1)), (11, 1, dt.datetime(2020, 2, 1))],
                                   "order_id int, customer_id int, purchased_at timestamp_ntz")
    items = spark.createDataFrame([(10, 5.0, 1.0), (10, 7.0, 1.0), (11, 3.0, 0.0)],
                                  "order_id int, price double, freight double")
    reviews = spark.createDataFrame([(10, 5), (10, 1), (11, 4)], "order_id int, review_score int")
    raw = commerce.customer_view(cust, orders, items, reviews, ["state"]).first()
    # order 10: 2 items x 2 reviews = 4 joined rows, as the recipe computes
    assert (raw["total_orders"], raw["products_purchased"], raw["total_spending"]) == (2, 5, 31.0)
    assert raw["avg_review"] == 3.2
    fixed = commerce.customer_view(cust, orders, items, reviews, ["state"], dedupe=True).first()
    assert (fixed["total_orders"], fixed["products_purchased"], fixed["total_spending"]) == (2, 3, 17.0)
    assert fixed["avg_order_value"] == 5.0 and fixed["avg_review"] == 3.33
