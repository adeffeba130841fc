"""Registry of every query: name -> (spark, sf_dir) -> DataFrame, and the
matching independent DuckDB SQL where the result is SQL-expressible."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ledgerline.plans import (audits, cleaning, epidemic, hotel_io, models, oracle_audits,
                              oracle_cleaning, oracle_epidemic, oracle_shop, reports, shop, staging,
                              warehouse)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "never_purchased": shop.never_purchased,
        "payment_mismatch": shop.payment_mismatch,
        "mom_growth": shop.mom_growth,
        "top_products_per_category": shop.top_products_per_category,
        "clv_tiers": shop.clv_tiers,
        "sales_rollup": shop.sales_rollup,
        "seasonal_top_categories": shop.seasonal_top_categories,
        "customer_360": shop.customer_360,
        "customer_360_two_reviews": partial(shop.customer_360, second_review=True),
        "customer_360_deduped": partial(shop.customer_360, second_review=True, dedupe=True),
        "bought_a_not_b": shop.bought_a_not_b,
        "best_seller_per_seller_category": shop.best_seller_per_seller_category,
        "bought_together": shop.bought_together,
        "late_deliveries": shop.late_deliveries,
        "above_state_average": shop.above_state_average,
        "second_highest_per_category": shop.second_highest_per_category,
        "consecutive_month_streaks": shop.consecutive_month_streaks,
        "consecutive_month_streaks_distinct": partial(shop.consecutive_month_streaks,
                                                      distinct_months=True),
        "moving_average_7": shop.moving_average_7,
        "order_gaps": shop.order_gaps,
        "top_sellers_per_state": shop.top_sellers_per_state,
        "running_revenue_pct": shop.running_revenue_pct,
        "running_line_revenue": shop.running_line_revenue,
        "moving_order_value": shop.moving_order_value,
        "dynamic_discount": shop.dynamic_discount,
        "sales_cube": shop.sales_cube,
        "clv_percentiles": shop.clv_percentiles,
        "line_correlations": shop.line_correlations,
    }
    q.update(epidemic.QUERIES)
    q.update(cleaning.QUERIES)
    q.update(audits.QUERIES)
    q.update(staging.QUERIES)
    q.update(hotel_io.QUERIES)
    q.update(models.QUERIES)
    q.update(warehouse.QUERIES)
    q.update({name: reports.presented(name, q[name]) for name in reports.ORDER})
    return q


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(oracle_shop.SQL)
    out.update(oracle_epidemic.SQL)
    out.update(oracle_cleaning.SQL)
    out.update(oracle_audits.SQL)
    out.update(staging.SQL)
    out.update(hotel_io.SQL)
    out.update(models.SQL)
    out.update(warehouse.SQL)
    return out
