"""Epidemic stand-ins derived from the driver tables.

``daily_facts``: a case is an order, a death an order with status 'F';
location = the customer's nation, continent = its region, population = the
number of customers. Aggregate locations (one per region and ``World``)
carry a NULL continent. ``daily_vacc``: a vaccination is a shipped line,
located at the supplier's nation, by ship day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.dates import day_start
from ledgerline.operators import epidemic as ep
from ledgerline.sources.tables import load


def _geo(spark, sf) -> DataFrame:
    n = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf, "region").select("r_regionkey", "r_name")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


def _levels(df: DataFrame, measures: list[str]) -> DataFrame:
    """Country rows plus region and ``World`` rows from one ``ROLLUP`` over
    the (day, region, nation) aggregate, so the input is scanned once.
    ``grouping_id`` (not NULL tests) tells the levels apart."""
    g = df.rollup("d", "r_name", "n_name").agg(*[F.sum(m).alias(m) for m in measures],
                                                 F.grouping_id().alias("_gid"))
    g = g.filter(F.col("_gid") != 7)  # drop the grand total over all days
    continent = F.when(F.col("_gid") == 0, F.col("r_name"))
    location = F.when(F.col("_gid") == 0, F.col("n_name")) \
                .when(F.col("_gid") == 1, F.col("r_name")).otherwise(F.lit("World"))
    return g.select(continent.alias("continent"), location.alias("location"), "d", *measures)


def _population(spark, sf, geo: DataFrame) -> DataFrame:
    c = load(spark, sf, "customer").select("c_nationkey")
    g = c.join(geo, c.c_nationkey == geo.n_nationkey).rollup("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("population"), F.grouping_id().alias("_gid"))
    location = F.when(F.col("_gid") == 0, F.col("n_name")) \
                .when(F.col("_gid") == 1, F.col("r_name")).otherwise(F.lit("World"))
    return g.select(location.alias("location"), "population")


def daily_facts(spark: SparkSession, sf: str) -> DataFrame:
    geo = _geo(spark, sf)
    c = load(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = load(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderstatus")
    base = (o.join(c, o.o_custkey == c.c_custkey)
             .join(geo, c.c_nationkey == geo.n_nationkey)
             .groupBy("r_name", "n_name", day_start("o_orderdate").alias("d"))
             .agg(F.count(F.lit(1)).alias("nc"),
                  F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("nd")))
    lv = _levels(base, ["nc", "nd"])
    w = Window.partitionBy("location").orderBy("d")
    return lv.join(_population(spark, sf, geo), "location").select(
        "continent", "location", F.col("d").alias("date"),
        F.col("population").cast("bigint").alias("population"),
        F.col("nc").cast("double").alias("new_cases"),
        F.sum("nc").over(w).cast("double").alias("total_cases"),
        F.col("nd").cast("string").alias("new_deaths"),
        F.sum("nd").over(w).cast("string").alias("total_deaths"))


def daily_vacc(spark: SparkSession, sf: str) -> DataFrame:
    geo = _geo(spark, sf)
    li = load(spark, sf, "lineitem").select("l_suppkey", "l_shipdate")
    s = load(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    base = (li.join(s, li.l_suppkey == s.s_suppkey)
              .join(geo, s.s_nationkey == geo.n_nationkey)
              .groupBy("r_name", "n_name", day_start("l_shipdate").alias("d"))
              .agg(F.count(F.lit(1)).alias("nv")))
    lv = _levels(base, ["nv"]).drop("continent")
    w = Window.partitionBy("location").orderBy("d")
    return lv.select("location", F.col("d").alias("date"),
                     F.col("nv").cast("string").alias("new_vaccinations"),
                     F.sum("nv").over(w).cast("double").alias("total_vaccinations"))


def _f(op):
    return lambda spark, sf: op(daily_facts(spark, sf))


def _fv(op):
    return lambda spark, sf: op(daily_facts(spark, sf), daily_vacc(spark, sf))


QUERIES = {
    "case_listing": _f(ep.case_listing),
    "case_listing_dashboard": _f(ep.case_listing_dashboard),
    "death_pct_daily": _f(ep.death_pct_daily),
    "infection_rate_daily": _f(ep.infection_rate_daily),
    "peak_infection_by_location": _f(ep.peak_infection_by_location),
    "peak_infection_by_location_all": _f(ep.peak_infection_by_location_all),
    "peak_infection_by_location_day": _f(lambda f: ep.peak_infection_by_location_all(f, True)),
    "peak_by_continent": _f(ep.peak_by_continent),
    "global_fatality": _f(ep.global_fatality),
    "global_fatality_unguarded": _f(lambda f: ep.global_fatality(f, guarded=False)),
    "deaths_by_aggregate_location": _f(ep.deaths_by_aggregate_location),
    "rolling_vaccinations": _fv(ep.rolling_vaccinations),
    "rolling_vaccinations_pct": _fv(ep.rolling_vaccinations_pct),
    "rolling_vaccinations_pct_int": _fv(lambda f, v: ep.rolling_vaccinations_pct(f, v, as_integer=True)),
    "pct_vaccinated_table": _fv(ep.pct_vaccinated_table),
    "pct_vaccinated_view": _fv(ep.pct_vaccinated_view),
    "max_vaccinations_daily": _fv(ep.max_vaccinations_daily),
}
