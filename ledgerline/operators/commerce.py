"""Basket, reconciliation and customer analytics (J1-J6, J10, O9, Q20-Q21,
Q27-Q28, Q30-Q32, Q39)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline import fixed_values as fv
from ledgerline.functions.dates import seconds_between
from ledgerline.operators.sequence import materialize


def reconcile_amounts(left: DataFrame, right: DataFrame, key: str, left_value: str,
                      right_value: str, tolerance: float = 1.0) -> DataFrame:
    """Keys whose two totals differ by more than ``tolerance``. Both sides
    arrive pre-aggregated to one row per key, so the join cannot fan out."""
    j = left.join(right, key)
    diff = F.col(left_value) - F.col(right_value)
    return j.filter((F.col(left_value) != F.col(right_value)) & (F.abs(diff) > tolerance))


def pair_counts(df: DataFrame, basket: str, item: str, names=("item_1", "item_2"),
                out: str = "pair_count", block_items: int = 1000) -> DataFrame:
    """How often two different items share a basket, counted over line
    pairs (a basket with 2 lines of a and 3 of b adds 6 to (a, b)).

    Lines are first collapsed to (basket, item, n), so duplicate lines never
    multiply the join; pairs are formed between distinct items of a basket with
    the product of their counts. The items of a basket with more than
    ``block_items`` are dealt into blocks by a hash, and each pair of blocks is
    a join key of its own: whatever share of the lines a basket holds, a key
    has at most about ``block_items ** 2`` pairs, which are counted before the
    next shuffle. Baskets with a single distinct item emit nothing; rows without
    a basket or item have no pair.
    """
    lines = materialize(df.filter(F.col(basket).isNotNull() & F.col(item).isNotNull())
                          .groupBy(F.col(basket).alias("_bk"), F.col(item).alias("_it"))
                          .agg(F.count(F.lit(1)).alias("_n")), "basket-lines")
    large = materialize(lines.groupBy("_bk").agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > block_items)
                             .select("_bk", F.ceil(F.col("_m") / block_items).cast("int").alias("_k")), "baskets-large")
    cut = lines.join(large, "_bk", "left").withColumn("_k", F.coalesce("_k", F.lit(1))) \
               .withColumn("_b", F.pmod(F.xxhash64("_it"), F.col("_k")).cast("int"))
    # the pair of blocks (i, j), i <= j: block i on the left, block j on the right
    left = cut.select("_bk", F.col("_b").alias("_i"), F.explode(F.sequence(F.col("_b"), F.col("_k") - 1)).alias("_j"),
                      F.col("_it").alias("_x"), F.col("_n").alias("_nx"))
    right = cut.select("_bk", F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"),
                       F.col("_it").alias("_y"), F.col("_n").alias("_ny"))
    pairs = left.join(right, ["_bk", "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("_x") < F.col("_y")))
    return pairs.groupBy(F.least("_x", "_y").alias(names[0]), F.greatest("_x", "_y").alias(names[1])).agg(
        F.sum(F.col("_nx") * F.col("_ny")).alias(out))


def in_a_not_b(df: DataFrame, key: str, is_a: Column, is_b: Column) -> DataFrame:
    """Keys with at least one row matching ``is_a`` and none matching
    ``is_b`` (``A EXCEPT B``) in one aggregation pass instead of two scans."""
    return (df.groupBy(key)
              .agg(F.max(F.coalesce(is_a, F.lit(False)).cast("int")).alias("_a"),
                   F.max(F.coalesce(is_b, F.lit(False)).cast("int")).alias("_b"))
              .filter((F.col("_a") == 1) & (F.col("_b") == 0))
              .select(key))


def above_group_average(df: DataFrame, value: str, by: Sequence[str],
                        avg_name: str = "group_avg", digits: int | None = None) -> DataFrame:
    """Rows whose ``value`` is strictly above the average of their group.
    The average is an aggregate joined back, NULL being a group as in a
    window. It is staged: both join sides are then plain shuffles, which is
    what AQE needs to split a hot group.

    Rows are compared by ``value * count > sum``, so exact values are compared
    exactly; ``digits`` rounds the reported average half up."""
    sums = materialize(df.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_cnt")), "group-avg")
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    avg = F.col("_sum").cast("double") / F.col("_cnt")
    if digits is not None:  # in whole units of the last digit where the sum is exact
        scale = 10 ** digits
        avg = F.floor((F.col("_sum") * (2 * scale) + F.col("_cnt")) / (F.col("_cnt") * 2)) / scale
    return df.join(sums, same).filter(F.col(value) * F.col("_cnt") > F.col("_sum")) \
             .withColumn(avg_name, avg).drop("_sum", "_cnt", *[f"_by{i}" for i in range(len(by))])


def late_events(df: DataFrame, actual: str, expected: str,
                tolerance_seconds: int = 24 * 3600, name: str = "delay_seconds") -> DataFrame:
    """Rows where ``actual - expected`` exceeds the tolerance (strict)."""
    delay = seconds_between(actual, expected)
    return df.withColumn(name, delay).filter(F.col(name) > tolerance_seconds)


def discount_rules(order_value: Column, prior_orders: Column,
                   new_pct: int = fv.NEW_CUSTOMER_PCT, big_pct: int = fv.BIG_ORDER_PCT,
                   big_threshold: float = fv.BIG_ORDER_THRESHOLD, loyal_pct: int = fv.LOYAL_PCT,
                   loyal_min: int = fv.LOYAL_MIN_ORDERS) -> Column:
    """One discount per order, first matching rule wins: no delivered orders
    -> 15; value above 500 -> 10; 5+ delivered orders -> 5; else 0."""
    return (F.when(F.coalesce(prior_orders, F.lit(0)) == 0, F.lit(new_pct))
             .when(order_value > big_threshold, F.lit(big_pct))
             .when(prior_orders >= loyal_min, F.lit(loyal_pct))
             .otherwise(F.lit(0)))


def discount(requests: DataFrame, history: DataFrame, key: str, value: str,
             delivered: Column, pct_name: str = "discount_percent",
             final_name: str = "final_amount") -> DataFrame:
    """Set-based form of the per-customer discount procedure: each request
    (key, value) gets the discount from its customer's delivered-order count.
    Customers absent from ``history`` count as new."""
    # staged, so that AQE can split a customer with many requests
    counts = materialize(history.filter(delivered).groupBy(key).agg(
        F.count(F.lit(1)).alias("delivered_orders")), "delivered")
    out = requests.join(counts, key, "left").withColumn(
        "delivered_orders", F.coalesce(F.col("delivered_orders"), F.lit(0)))
    pct = discount_rules(F.col(value), F.col("delivered_orders"))
    out = out.withColumn(pct_name, pct)
    return out.withColumn(final_name, F.col(value) - F.col(value) * F.col(pct_name) / 100)


def customer_view(customers: DataFrame, orders: DataFrame, items: DataFrame,
                  reviews: DataFrame, customer_keys: list[str], dedupe: bool = False) -> DataFrame:
    """Per-customer view: orders, items bought, spending, average item price,
    average review, first and last purchase.

    Inputs (already restricted by whatever inner joins the view requires):
    ``customers(customer_id, *customer_keys)``, ``orders(order_id,
    customer_id, purchased_at)``, ``items(order_id, price, freight)``,
    ``reviews(order_id, review_score)``.

    ``dedupe=False`` keeps the recipe's semantics: items and reviews are
    joined on the order, so an order with 2 items and 2 reviews contributes
    4 rows to every item and review aggregate. ``dedupe=True`` aggregates
    items and reviews per order first and combines the per-order partials,
    so nothing is multiplied; orders without items or reviews are still
    dropped, as the inner joins do.
    """
    keys = ["customer_id", *customer_keys]
    if not dedupe:
        j = (customers.join(orders, "customer_id").join(items, "order_id")
                      .join(reviews, "order_id"))
        return j.groupBy(*keys).agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.count("price").alias("products_purchased"),
            F.sum(F.col("price") + F.col("freight")).cast("double").alias("total_spending"),
            (F.sum("price").cast("double") / F.count("price")).alias("avg_order_value"),
            (F.floor((F.sum("review_score") * 200 + F.count("review_score")) /
                     (F.count("review_score") * 2)) / 100).alias("avg_review"),
            F.min("purchased_at").alias("first_purchase_date"),
            F.max("purchased_at").alias("last_purchase_date"))
    per_item = items.groupBy("order_id").agg(
        F.count("price").alias("_n"), F.sum("price").alias("_p"),
        F.sum(F.col("price") + F.col("freight")).alias("_s"))
    per_review = reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("_rs"), F.count("review_score").alias("_rn"))
    j = customers.join(orders, "customer_id").join(per_item, "order_id").join(per_review, "order_id")
    return j.groupBy(*keys).agg(
        F.count_distinct("order_id").alias("total_orders"),
        F.sum("_n").alias("products_purchased"),
        F.sum("_s").cast("double").alias("total_spending"),
        (F.sum("_p").cast("double") / F.sum("_n")).alias("avg_order_value"),
        (F.floor((F.sum("_rs") * 200 + F.sum("_rn")) / (F.sum("_rn") * 2)) / 100).alias("avg_review"),
        F.min("purchased_at").alias("first_purchase_date"),
        F.max("purchased_at").alias("last_purchase_date"))
