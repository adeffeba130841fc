"""Staging audits and single cleaning steps on the driver tables.

Stand-ins: a "person" key for customers is segment + nation (several
customer ids per person); the loaded order set is orders placed before
2001 and the product catalogue is parts of size <= 40, so lines outside
them are orphans; a document's words are its whitespace-separated tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.fixed_values import MISSING_ORDER, MISSING_PRODUCT
from ledgerline.functions import numeric, text
from ledgerline.operators import audit, clean
from ledgerline.sources.tables import load

LOADED_BEFORE = "2001-01-01"
CATALOGUE_MAX_SIZE = 40
WORD_SPLIT = "[ \t\n\r]+"


def loaded_orders(spark, sf) -> DataFrame:
    return load(spark, sf, "orders").filter(
        F.col("o_orderdate") < F.lit(LOADED_BEFORE).cast("timestamp_ntz"))


def catalogue(spark, sf) -> DataFrame:
    return load(spark, sf, "part").filter(F.col("p_size") <= CATALOGUE_MAX_SIZE)


def words(spark, sf) -> DataFrame:
    d = load(spark, sf, "documents").select("text")
    return d.select(F.explode(F.split("text", WORD_SPLIT)).alias("word")) \
            .filter(F.col("word") != "")


def normalize_customers(spark, sf):
    c = load(spark, sf, "customer")
    return clean.normalize_strings(c, trim=["c_name"], lower=["c_mktsegment"],
                                   blank_to_null=["c_name", "c_mktsegment"])


def zero_to_null(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return clean.value_to_null(li, ["l_discount", "l_tax"], 0.0)


def duplicate_line_keys(spark, sf):
    return audit.duplicate_keys(load(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def duplicate_document_texts(spark, sf):
    """Surplus copies of identical texts. Texts are compared through their
    128-bit digest (computed over the whole text), so the shuffle carries
    16 bytes per document instead of the text."""
    d = load(spark, sf, "documents").select(F.md5("text").alias("text_md5"))
    return clean.duplicate_rows(d, ["text_md5"])


def dedup_documents(spark, sf):
    """Of documents with equal text and language the one with the smallest id,
    compared by digest so that the text isn't shuffled."""
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("text_md5"), "lang")
    return d.groupBy("text_md5", "lang").agg(F.min("doc_id").alias("doc_id"))


def _persons(spark, sf) -> DataFrame:
    c = load(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"),
                    F.concat_ws("-", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))
                    .alias("customer_unique_id"), "c_name")


def dedup_keep_last_customer(spark, sf):
    return clean.dedup(_persons(spark, sf), ["customer_unique_id"], ["customer_id"], keep="last")


def dedup_reconcile(spark, sf):
    """Rows before and after keeping one customer per person key."""
    return audit.dedup_counts(_persons(spark, sf), ["customer_unique_id"])


def orphan_lines(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return audit.orphans(li, loaded_orders(spark, sf), {"l_orderkey": "o_orderkey"})


def orphan_lines_labelled(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    out = audit.orphans_labelled(li, [
        (MISSING_ORDER, loaded_orders(spark, sf), "l_orderkey", "o_orderkey"),
        (MISSING_PRODUCT, catalogue(spark, sf), "l_partkey", "p_partkey")])
    return out.select(F.col("l_orderkey").alias("order_id"),
                      F.col("l_partkey").alias("product_id"), "orphan_type")


def missing_catalogue_parts(spark, sf):
    li = load(spark, sf, "lineitem")
    return audit.missing_members(li, catalogue(spark, sf), "l_partkey", "p_partkey") \
                .select(F.col("l_partkey").alias("product_id"))


def complete_catalogue(spark, sf):
    li = load(spark, sf, "lineitem")
    cat = catalogue(spark, sf).select(F.col("p_partkey"), F.col("p_name"))
    return audit.complete_dimension(li, cat, "l_partkey", "p_name", "p_partkey") \
                .select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_label"))


def ship_before_order(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return audit.violations(j, {"shipped_before_order": F.col("l_shipdate") < F.col("o_orderdate")},
                            ["l_orderkey", "l_linenumber", "l_shipdate", "o_orderdate"])


def part_range_check(spark, sf):
    p = load(spark, sf, "part")
    rules = {"size_over_45": F.col("p_size") > 45,
             "price_over_1900": F.col("p_retailprice") > 1900,
             "size_not_positive": F.col("p_size") <= 0}
    return audit.violations(p, rules, ["p_partkey"])


def inconsistent_line_flags(spark, sf):
    return audit.inconsistent_attributes(load(spark, sf, "lineitem"), "l_orderkey",
                                         ["l_returnflag", "l_linestatus"])


def null_audit_catalogue(spark, sf):
    li = load(spark, sf, "lineitem").select("l_partkey")
    cat = catalogue(spark, sf).select("p_partkey", "p_name", "p_brand", "p_type")
    j = li.join(cat, li.l_partkey == cat.p_partkey, "left")
    return audit.null_audit(j, ["p_name", "p_brand", "p_type"])


def non_ascii_words(spark, sf):
    return audit.pattern_audit(words(spark, sf), "word", "[^\\x00-\\x7F]")


def digit_words(spark, sf):
    return audit.pattern_audit(words(spark, sf), "word", "[0-9]")


def customer_zip(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"),
                    text.pad_code("c_nationkey", 5).alias("customer_zip_code_prefix"))


def nation_centroid(spark, sf):
    c = load(spark, sf, "customer").select(
        text.pad_code("c_nationkey", 5).alias("zip_code_prefix"),
        numeric.money("c_acctbal").alias("acctbal"), "c_mktsegment", "c_name")
    return audit.group_centroid(c, "zip_code_prefix", {"mean_acctbal": "acctbal"},
                                {"max_segment": "c_mktsegment", "max_name": "c_name"})


def accent_fold_documents(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    folded = text.fold_key("text")
    return d.select("doc_id", F.md5(folded).alias("folded_md5"),
                    F.length(folded).alias("folded_chars"))


def segment_histogram(spark, sf):
    return audit.value_histogram(load(spark, sf, "customer"), "c_mktsegment", "n")


QUERIES = {
    "normalize_customers": normalize_customers,
    "zero_to_null": zero_to_null,
    "duplicate_line_keys": duplicate_line_keys,
    "duplicate_document_texts": duplicate_document_texts,
    "dedup_documents": dedup_documents,
    "dedup_keep_last_customer": dedup_keep_last_customer,
    "dedup_reconcile": dedup_reconcile,
    "orphan_lines": orphan_lines,
    "orphan_lines_labelled": orphan_lines_labelled,
    "missing_catalogue_parts": missing_catalogue_parts,
    "complete_catalogue": complete_catalogue,
    "ship_before_order": ship_before_order,
    "part_range_check": part_range_check,
    "inconsistent_line_flags": inconsistent_line_flags,
    "null_audit_catalogue": null_audit_catalogue,
    "non_ascii_words": non_ascii_words,
    "digit_words": digit_words,
    "customer_zip": customer_zip,
    "nation_centroid": nation_centroid,
    "accent_fold_documents": accent_fold_documents,
    "segment_histogram": segment_histogram,
}


# --- e-commerce raw -> staging (C33) -----------------------------------------

def shop_raw(spark, sf) -> dict:
    """Raw e-commerce tables derived from the driver tables: ids as padded
    text, blank categories for the largest parts, weight = size - 1 (so
    size 1 weighs 0), categories in lower case with an English label."""
    c = load(spark, sf, "customer")
    n = load(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf, "region").select("r_regionkey", "r_name")
    cust = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
             .select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" "))
                     .alias("customer_id"),
                     F.concat_ws("-", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))
                     .alias("customer_unique_id"),
                     F.col("c_nationkey").alias("customer_zip_code_prefix"),
                     F.concat(F.col("n_name"), F.lit(" ")).alias("customer_city"),
                     F.col("r_name").alias("customer_state")))
    p = load(spark, sf, "part")
    prod = p.select(F.col("p_partkey").cast("string").alias("product_id"),
                    F.when(F.col("p_size") > 45, F.lit(" "))
                     .otherwise(F.lower("p_type")).alias("product_category_name"),
                    (F.col("p_size") - 1).alias("product_weight_g"))
    trans = p.filter(F.col("p_size") <= 5).select(
        F.lower("p_type").alias("product_category_name"),
        F.col("p_type").alias("product_category_name_english")).distinct()
    return {"customers": cust, "products": prod, "product_category_name_translation": trans}


def staging_customers(spark, sf):
    from ledgerline.operators.workflows import stage_shop_tables
    return stage_shop_tables(shop_raw(spark, sf))["customers"]


def staging_products(spark, sf):
    from ledgerline.operators.workflows import stage_shop_tables
    return stage_shop_tables(shop_raw(spark, sf))["products"]


def staging_categories(spark, sf):
    from ledgerline.operators.workflows import stage_shop_tables
    return stage_shop_tables(shop_raw(spark, sf))["product_category_name_translation"]


QUERIES.update({
    "staging_customers": staging_customers,
    "staging_products": staging_products,
    "staging_categories": staging_categories,
})
