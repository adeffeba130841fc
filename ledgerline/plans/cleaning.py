"""Layoffs and housing stand-ins derived from the driver tables, their
cleaning workflows and the exploration queries.

Layoffs: one raw report per line item (so every order is reported as many
times as it has lines: exact duplicates); company = customer name (padded
for low-priority orders), industry = market segment (blank for unspecified
priority, suffixed ' Goods' for pending orders), country = region (a
trailing '.' on pending orders), date = order date as 'M/d/yyyy' text.
Housing: one sale per order; parcel = customer; address = 'name, nation'
(missing for low priority, no comma for unspecified priority).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.fixed_values import VACANT_RECODE
from ledgerline.functions import dates, text
from ledgerline.operators import audit, clean, explore, workflows
from ledgerline.operators.sequence import materialize
from ledgerline.sources.tables import load

INDUSTRY_PREFIX = ("MACHINERY", "MACHINERY")
COUNTRY_PREFIX = "AMERICA"


def _order_geo(spark, sf) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                         "o_totalprice", "o_orderdate", "o_orderpriority")
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey",
                                           "c_acctbal", "c_mktsegment")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf, "region").select("r_regionkey", "r_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey))


def layoffs_raw(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey")
    j = li.join(_order_geo(spark, sf), F.col("l_orderkey") == F.col("o_orderkey"))
    prio, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    unmeasured = (status == "O") & (prio == "1-URGENT")
    return j.select(
        F.when(prio == "5-LOW", F.concat(F.lit(" "), "c_name", F.lit(" ")))
         .otherwise(F.col("c_name")).alias("company"),
        F.col("n_name").alias("location"),
        F.when(prio == "4-NOT SPECIFIED", F.lit(""))
         .when(status == "P", F.concat("c_mktsegment", F.lit(" Goods")))
         .otherwise(F.col("c_mktsegment")).alias("industry"),
        F.when(unmeasured, F.lit(None))
         .otherwise(F.floor(F.col("o_totalprice") / 1000)).cast("int").alias("total_laid_off"),
        F.when(unmeasured, F.lit(None).cast("string"))
         .when(prio == "1-URGENT", F.lit("1")).when(prio == "2-HIGH", F.lit("0.95"))
         .when(prio == "3-MEDIUM", F.lit("1.0")).otherwise(F.lit("0.1"))
         .alias("percentage_laid_off"),
        F.date_format("o_orderdate", "M/d/yyyy").alias("date"),
        prio.alias("stage"),
        F.when(status == "P", F.concat("r_name", F.lit("."))).otherwise(F.col("r_name"))
         .alias("country"),
        F.floor(F.col("c_acctbal") / 100).cast("int").alias("funds_raised_millions"))


def layoffs_clean(spark, sf) -> DataFrame:
    return workflows.clean_layoffs(layoffs_raw(spark, sf), INDUSTRY_PREFIX, COUNTRY_PREFIX)


def _unfilled(spark, sf) -> DataFrame:
    """The cleaned rows for reports that don't use the industry."""
    return workflows.clean_layoffs(layoffs_raw(spark, sf), INDUSTRY_PREFIX, COUNTRY_PREFIX,
                                   fill_industry=False)


def housing_raw(spark: SparkSession, sf: str) -> DataFrame:
    j = _order_geo(spark, sf)
    prio = F.col("o_orderpriority")
    return j.select(
        F.col("o_orderkey").alias("UniqueID"),
        F.concat(F.lit("P-"), F.col("o_custkey").cast("string")).alias("ParcelID"),
        F.when(prio == "5-LOW", F.lit(None).cast("string"))
         .when(prio == "4-NOT SPECIFIED", F.col("c_name"))
         .otherwise(F.concat_ws(", ", "c_name", "n_name")).alias("PropertyAddress"),
        dates.month_start("o_orderdate").alias("SaleDate"),
        (F.floor(F.col("o_totalprice") / 10000) * 10000).cast("bigint").alias("SalePrice"),
        F.col("o_orderstatus").alias("LegalReference"),
        F.when(prio == "1-URGENT",
               F.concat_ws(", ", "c_name", F.lit("Unit 1"), "n_name", "r_name", F.lit("Earth")))
         .when(prio == "5-LOW", F.concat_ws(", ", "c_name", "n_name"))
         .otherwise(F.concat_ws(", ", "c_name", "n_name", "r_name")).alias("OwnerAddress"),
        F.when(prio == "1-URGENT", "Y").when(prio == "2-HIGH", "N")
         .when(prio == "3-MEDIUM", "Yes").otherwise("No").alias("SoldAsVacant"),
        F.col("r_name").alias("TaxDistrict"))


# --- layoffs: single steps -------------------------------------------------

def layoffs_duplicate_rows(spark, sf):
    return clean.duplicate_rows(layoffs_raw(spark, sf))


def layoffs_dedup_audit(spark, sf):
    return audit.dedup_counts(layoffs_raw(spark, sf))


def layoffs_peer_fill_preview(spark, sf):
    """Rows with a missing industry after the earlier cleaning steps, with
    the peer value that would fill them."""
    d = (materialize(clean.dedup_exact(layoffs_raw(spark, sf)), "layoffs-dedup")
         .withColumn("company", F.trim("company"))
         .withColumn("industry", text.recode_prefix("industry", *INDUSTRY_PREFIX))
         .withColumn("industry", F.nullif(F.col("industry"), F.lit(""))))
    return clean.donor_preview(d, "company", "industry", "industry",
                               show=["location", "stage", "date"], blank_is_null=False)


def industry_domain(spark, sf):
    return audit.domain_values(layoffs_clean(spark, sf), "industry")


def parse_us_dates(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    t = o.withColumn("date_text", F.date_format("o_orderdate", "M/d/yyyy"))
    return t.select("o_orderkey", "date_text",
                    dates.parse_date("date_text", "M/d/yyyy").alias("parsed_date"))


def max_measures(spark, sf):
    return explore.max_measures(_unfilled(spark, sf),
                                ["total_laid_off", "percentage_laid_off"])


def complete_shutdowns(spark, sf):
    return explore.rows_where_equal(layoffs_clean(spark, sf), "percentage_laid_off", 1)


def _total(dim):
    def q(spark, sf):
        rows = layoffs_clean if dim == "industry" else _unfilled
        return explore.total_by(rows(spark, sf), dim, "total_laid_off", "total_laid_off")
    return q


def total_by_year(spark, sf):
    return explore.total_by(_unfilled(spark, sf), F.year("date").alias("year"),
                            "total_laid_off", "total_laid_off")


def rolling_total_by_year(spark, sf):
    return explore.rolling_total_by_period(_unfilled(spark, sf),
                                           dates.year_text("date"), "total_laid_off")


def rolling_total_by_month(spark, sf):
    return explore.rolling_total_by_period(_unfilled(spark, sf),
                                           dates.year_month_text("date"), "total_laid_off")


def top_companies_per_year(spark, sf):
    return explore.top_per_period(_unfilled(spark, sf), "company", F.year("date"),
                                  "total_laid_off", 5)


# --- housing ----------------------------------------------------------------

def housing_clean(spark, sf):
    return workflows.clean_housing(housing_raw(spark, sf))


def housing_fill_preview(spark, sf):
    return clean.donor_preview(housing_raw(spark, sf), "ParcelID", "PropertyAddress",
                               "UniqueID", show=["UniqueID"], blank_is_null=False)


def housing_split_address(spark, sf):
    h = clean.fill_from_group(housing_raw(spark, sf), "ParcelID", "PropertyAddress",
                              "UniqueID", blank_is_null=False)
    head, tail = text.split_first("PropertyAddress")
    return h.select("UniqueID", "PropertyAddress", head.alias("PropSplitAddress"),
                    tail.alias("PropSplitCity"))


def housing_split_owner(spark, sf):
    h = housing_raw(spark, sf)
    return h.select("UniqueID", "OwnerAddress",
                    text.split_right("OwnerAddress", 3).alias("OwnerSplitAddress"),
                    text.split_right("OwnerAddress", 2).alias("OwnerSplitCity"),
                    text.split_right("OwnerAddress", 1).alias("OwnerSplitState"))


def sold_as_vacant_histogram(spark, sf):
    return audit.value_histogram(housing_raw(spark, sf), "SoldAsVacant", "n")


def sold_as_vacant_recode(spark, sf):
    h = housing_raw(spark, sf)
    return h.select("UniqueID", "SoldAsVacant",
                    text.recode("SoldAsVacant", VACANT_RECODE).alias("Revised"))


def housing_dedup(spark, sf):
    h = housing_raw(spark, sf)
    keys = ["ParcelID", "PropertyAddress", "SaleDate", "SalePrice", "LegalReference"]
    return clean.dedup(h, keys, ["UniqueID"], "first").select("UniqueID", *keys)


def housing_sale_dates(spark, sf):
    h = housing_raw(spark, sf)
    return h.select("UniqueID", "SaleDate", dates.to_date_only("SaleDate").alias("SaleDateConverted"))


QUERIES = {
    "layoffs_clean": layoffs_clean,
    "layoffs_duplicate_rows": layoffs_duplicate_rows,
    "layoffs_dedup_audit": layoffs_dedup_audit,
    "layoffs_peer_fill_preview": layoffs_peer_fill_preview,
    "industry_domain": industry_domain,
    "parse_us_dates": parse_us_dates,
    "max_measures": max_measures,
    "complete_shutdowns": complete_shutdowns,
    "total_by_company": _total("company"),
    "total_by_industry": _total("industry"),
    "total_by_stage": _total("stage"),
    "total_by_year": total_by_year,
    "rolling_total_by_year": rolling_total_by_year,
    "rolling_total_by_month": rolling_total_by_month,
    "top_companies_per_year": top_companies_per_year,
    "housing_clean": housing_clean,
    "housing_fill_preview": housing_fill_preview,
    "housing_split_address": housing_split_address,
    "housing_split_owner": housing_split_owner,
    "sold_as_vacant_histogram": sold_as_vacant_histogram,
    "sold_as_vacant_recode": sold_as_vacant_recode,
    "housing_dedup": housing_dedup,
    "housing_sale_dates": housing_sale_dates,
}
