"""Queries that load and keep tables: layered namespaces, updates of
partitions, bucketed facts, counts observed while writing, collated text, the
discount as a SQL table function, merged quantile sketches.

Stand-ins as in the other plans; for the collated keys, a customer's market
segment is spelled in four ways (as is, in capitals, in small letters, with an
accented A)."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.dates import day_start, month_start
from ledgerline.functions.numeric import money
from ledgerline.functions.sql import register_discount_table
from ledgerline.operators import audit, clean, stats
from ledgerline.operators import epidemic as ep
from ledgerline.operators.sequence import discard, materialize, staging_folder
from ledgerline.operators.workflows import stage_shop_tables
from ledgerline.plans import epidemic, staging
from ledgerline.plans.audits import shop_raw
from ledgerline.sources.files import update_rows, write_extract
from ledgerline.sources.layers import Layers
from ledgerline.sources.tables import load


def _own(tag: str) -> str:
    return f"{tag}_{uuid.uuid4().hex[:12]}_"


def layered_revenue(spark, sf) -> DataFrame:
    """Raw orders and customers, staging tables made of them in SQL by their
    qualified names, and an analytics table of revenue, read back."""
    with Layers(spark, prefix=_own("ll")) as at:
        at.save(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"),
                "raw", "orders")
        at.save(load(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "raw", "customers")
        spark.sql(f"""
            CREATE TABLE {at.name('staging', 'orders')} USING parquet AS
            SELECT o_orderkey AS order_id, o_custkey AS customer_id, lower(trim(o_orderstatus)) AS order_status,
                   CAST(o_totalprice AS DECIMAL(18,2)) AS paid, trunc(CAST(o_orderdate AS DATE), 'MM') AS month
            FROM {at.name('raw', 'orders')}""")
        spark.sql(f"""
            CREATE TABLE {at.name('staging', 'customers')} USING parquet AS
            SELECT c_custkey AS customer_id, lower(trim(c_mktsegment)) AS segment
            FROM {at.name('raw', 'customers')}""")
        out = spark.sql(f"""
            SELECT c.segment, o.month, count(*) AS orders, CAST(sum(o.paid) AS DOUBLE) AS revenue
            FROM {at.name('staging', 'orders')} o JOIN {at.name('staging', 'customers')} c USING (customer_id)
            WHERE o.order_status = 'f' GROUP BY c.segment, o.month""")
        return materialize(at.save(out, "analytics", "revenue"), "layered-revenue")


def update_partitions(spark, sf) -> DataFrame:
    """Orders in a table partitioned by year, of which the pending ones are then
    set to 'X' and rounded down; only years with pending orders are rewritten."""
    path = f"{staging_folder(spark)}/orders-by-year-{uuid.uuid4().hex}"
    o = load(spark, sf, "orders").withColumn("o_year", F.year("o_orderdate"))
    write_extract(o, path, partition_by=("o_year",))
    update_rows(spark, path, ["o_year"], F.col("o_orderstatus") == "P",
                {"o_orderstatus": F.lit("X"), "o_totalprice": F.floor("o_totalprice")})
    return spark.read.schema(o.schema).parquet(path).select("o_orderkey", "o_orderstatus", "o_totalprice", "o_year")


def rolling_vaccinations_bucketed(spark, sf) -> DataFrame:
    """The rolling vaccinations over fact tables bucketed and sorted by location
    and date: they are joined without a shuffle."""
    with Layers(spark, ["facts"], prefix=_own("ll")) as at:
        f, v = epidemic.daily_facts(spark, sf), epidemic.daily_vacc(spark, sf)
        n = at.bucket_count(f, v)
        f = at.save(f, "facts", "deaths", bucket_by=["location", "date"], buckets=n)
        v = at.save(v, "facts", "vaccinations", bucket_by=["location", "date"], buckets=n)
        return materialize(ep.rolling_vaccinations(f, v), "rolling")


AUDITED = ("orders", "order_items", "reviews", "payments", "customers", "sellers")


def staging_audit(spark, sf) -> DataFrame:
    """Rows before and after staging and values missing per table, observed
    while the staging tables are written."""
    rows = []
    for name in AUDITED:
        raw = audit.Observed(shop_raw(spark, sf)["customers"] if name == "customers" else staging.RAW[name](spark, sf))
        done = stage_shop_tables({name: raw.df}, review_order="load_no" if name == "reviews" else None)[name]
        kept = audit.Observed(done, [c for c in done.columns if c != "load_no"])
        discard(materialize(kept.df, f"audit-{name}"))
        rows.append((name, raw.rows, kept.rows, raw.rows - kept.rows, sum(kept.missing.values())))
    return spark.createDataFrame(rows, "table_name string, rows_before long, rows_after long, removed long, missing long")


def _spelled(c):
    way = F.col("c_custkey") % 4
    return F.when(way == 0, c).when(way == 1, F.upper(c)).when(way == 2, F.lower(c)) \
            .otherwise(F.translate(c, "Aa", "ÁÀ"))


def collated_segments(spark, sf) -> DataFrame:
    """Segments spelled in any way: de-duplicated under the collation, then the
    customers of each by a join under it."""
    c = load(spark, sf, "customer").select("c_custkey", _spelled(F.col("c_mktsegment")).alias("segment"))
    distinct = clean.dedup_collated(c.select("segment"), ["segment"])
    names = distinct.withColumnRenamed("segment", "name")
    who = clean.join_collated(c, names, "segment", "name")
    return who.groupBy(F.lower(F.translate("name", "ÁÀ", "AA")).alias("segment")).agg(
        F.count(F.lit(1)).alias("customers"), F.count_distinct("segment").alias("spellings"))


def dynamic_discount_sql(spark, sf) -> DataFrame:
    """Every order as a request, by the SQL table function."""
    o = load(spark, sf, "orders")
    tag = _own("v")
    history, requests = f"{tag}history", f"{tag}requests"
    o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("customer_id")).createOrReplaceTempView(history)
    o.select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
             (money("o_totalprice") * F.lit(Decimal("0.001"))).cast("decimal(20,5)").alias("order_value")) \
     .createOrReplaceTempView(requests)
    register_discount_table(spark, history, name=f"{tag}discount", rule=f"{tag}rule")
    return spark.sql(f"""
        SELECT r.order_id, r.customer_id, CAST(r.order_value AS DOUBLE) AS order_value, h.delivered_orders,
               t.discount_percent, CAST(t.final_amount AS DOUBLE) AS final_amount
        FROM {requests} r, LATERAL {tag}discount_history(r.customer_id) h,
             LATERAL {tag}discount_terms(h.delivered_orders, r.order_value) t""")


PERCENTS = (25, 50, 75, 90, 99)


def percentiles_by_month(spark, sf) -> DataFrame:
    """Percentiles of order values per month from one sketch a day, merged; each
    is compared with the exact ranks of its month."""
    o = load(spark, sf, "orders").select(day_start("o_orderdate").alias("day"), F.col("o_totalprice").alias("value"))
    daily = materialize(stats.sketches(o, ["day"], "value"), "daily-sketches")
    monthly = stats.merged(daily.withColumn("month", month_start("day")), ["month"])
    asked = materialize(stats.sketch_percentiles(monthly, PERCENTS), "month-percentiles")
    # exact rank of each answer: rows below it, and not above it
    values = o.select(month_start("day").alias("month"), F.col("value").alias("v"))
    ranks = values.join(asked, "month").groupBy("month", "n", "percentile").agg(
        F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    want, slack = F.col("n") * F.col("percentile") / 100, F.col("n") * stats.RANK_ERROR + 1
    return ranks.select("month", "percentile", F.col("n").alias("orders"),
                        ((F.col("below") <= want + slack) & (F.col("upto") >= want - slack)).alias("within_bound"))


def reviews_without_order(spark, sf) -> DataFrame:
    """Reviews whose order went with its customer's de-duplication."""
    customers = stage_shop_tables({"customers": shop_raw(spark, sf)["customers"]})["customers"]
    orders = staging.staged(spark, sf, "orders").join(customers.select("customer_id"), "customer_id", "left_semi")
    return audit.orphans(staging.staged(spark, sf, "reviews"), orders, "order_id") \
                .select("review_id", "order_id", "review_score")


QUERIES = {
    "layered_revenue": layered_revenue,
    "update_partitions": update_partitions,
    "rolling_vaccinations_bucketed": rolling_vaccinations_bucketed,
    "staging_audit": staging_audit,
    "collated_segments": collated_segments,
    "dynamic_discount_sql": dynamic_discount_sql,
    "percentiles_by_month": percentiles_by_month,
    "reviews_without_order": reviews_without_order,
}

SQL = {
"layered_revenue": """
SELECT lower(c_mktsegment) AS segment, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY ALL""",
"update_partitions": """
SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
       CASE o_orderstatus WHEN 'P' THEN floor(o_totalprice) ELSE o_totalprice END AS o_totalprice,
       CAST(year(o_orderdate) AS INTEGER) AS o_year
FROM orders""",
"collated_segments": """
SELECT lower(c_mktsegment) AS segment, count(*) AS customers,
       count(DISTINCT CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN upper(c_mktsegment)
                      WHEN 2 THEN lower(c_mktsegment) ELSE translate(c_mktsegment, 'Aa', 'ÁÀ') END) AS spellings
FROM customer GROUP BY 1""",
"percentiles_by_month": f"""
SELECT date_trunc('month', o_orderdate) AS month, p::INTEGER AS percentile, count(*) AS orders, true AS within_bound
FROM orders, (SELECT unnest({list(PERCENTS)}) AS p) GROUP BY ALL""",
"reviews_without_order": """
WITH kept AS (SELECT max(CAST(c_custkey AS VARCHAR)) AS id FROM customer GROUP BY lower(c_mktsegment), c_nationkey),
latest AS (SELECT o_orderkey // 2 AS pair, max(o_orderkey) AS o_orderkey FROM orders GROUP BY pair)
SELECT 'r' || pair AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id,
       CASE o_orderstatus WHEN 'P' THEN 0 ELSE CAST(o_orderpriority[1] AS INTEGER) END AS review_score
FROM latest JOIN orders USING (o_orderkey) WHERE CAST(o_custkey AS VARCHAR) NOT IN (SELECT id FROM kept)""",
}


def _audit_sql() -> str:
    from ledgerline.plans import oracle_audits
    before = {"order_items": "lineitem", "customers": "customer", "sellers": "supplier"}
    told = {**staging.SQL, **oracle_audits.SQL}
    parts = []
    for name in AUDITED:
        body = told[f"staging_{name}"]
        parts.append(f"""
SELECT '{name}' AS table_name, (SELECT count(*) FROM {before.get(name, 'orders')}) AS rows_before, s.n AS rows_after,
       (SELECT count(*) FROM {before.get(name, 'orders')}) - s.n AS removed, s.missing
FROM (SELECT count(*) AS n, CAST(coalesce(sum(len(list_filter(json_extract(to_json(t), '$.*'), lambda x: x = 'null'))), 0) AS BIGINT) AS missing
      FROM ({body}) t) s""")
    return "\nUNION ALL\n".join(parts)


SQL["staging_audit"] = _audit_sql()


def _same_as(name: str) -> str:
    from ledgerline.plans import oracle_epidemic, oracle_shop
    return {**oracle_epidemic.SQL, **oracle_shop.SQL}[name]


SQL["rolling_vaccinations_bucketed"] = _same_as("rolling_vaccinations")
SQL["dynamic_discount_sql"] = _same_as("dynamic_discount")
