"""Ordered cleaning workflows (C33) composed from the single-step
operators with ``DataFrame.transform``. Order matters: blanks become NULL
before the peer fill, de-duplication runs on the raw values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.fixed_values import US_DATE_FORMAT, VACANT_RECODE
from ledgerline.functions import dates, text
from ledgerline.operators import clean
from ledgerline.operators.sequence import materialize


def clean_layoffs(raw: DataFrame, recode_prefix: tuple[str, str] = ("Crypto", "Crypto"),
                     country_prefix: str = "United States", date_format: str = US_DATE_FORMAT,
                     fold_company: bool = False, materialize_dedup: bool = True,
                     fill_industry: bool = True) -> DataFrame:
    """Raw layoffs -> cleaned layoffs:
    exact de-duplication, trim company, collapse an industry prefix, strip
    trailing dots from matching countries, parse the date text, blank
    industry -> NULL, fill industry from the same company, drop rows
    without any measure.

    The peer fill reads the de-duplicated rows twice (donors, and the rows
    to fill, which the final delete filters early), so by default the
    de-duplicated layer is written once to the checkpoint folder (a staging
    table) instead of being recomputed for each branch. A report that doesn't
    use the industry can leave the fill out (``fill_industry=False``): the
    rows are the same, and the layer is then read once and not staged."""
    fold = ("company",) if fold_company else ()
    staged = clean.dedup_exact(raw, fold=fold)
    if materialize_dedup and fill_industry:
        staged = materialize(staged, "layoffs-dedup")
    out = (staged
            .withColumn("company", F.trim("company"))
            .withColumn("industry", text.recode_prefix("industry", *recode_prefix))
            .withColumn("country", text.strip_trailing("country", ".", country_prefix))
            .withColumn("date", dates.parse_date("date", date_format))
            .withColumn("industry", F.nullif(F.col("industry"), F.lit(""))))
    if fill_industry:
        out = clean.fill_from_group(out, "company", "industry", "industry",
                                    blank_is_null=False, fold=fold_company)
    return clean.drop_unmeasured(out, ["total_laid_off", "percentage_laid_off"])


def clean_housing(raw: DataFrame) -> DataFrame:
    """Raw sales -> cleaned sales: date-only sale date, property address
    filled from the same parcel, address/city split at the first comma,
    owner address split from the right, Y/N recoded, duplicate sales (same
    parcel, address, date, price, legal reference) reduced to the lowest
    UniqueID, raw columns dropped."""
    out = raw.withColumn("SaleDateConverted", dates.to_date_only("SaleDate"))
    out = clean.fill_from_group(out, "ParcelID", "PropertyAddress", "UniqueID",
                                blank_is_null=False)
    head, tail = text.split_first("PropertyAddress")
    out = out.withColumn("PropSplitAddress", head).withColumn("PropSplitCity", tail)
    out = (out.withColumn("OwnerSplitAddress", text.split_right("OwnerAddress", 3))
              .withColumn("OwnerSplitCity", text.split_right("OwnerAddress", 2))
              .withColumn("OwnerSplitState", text.split_right("OwnerAddress", 1))
              .withColumn("SoldAsVacant", text.recode("SoldAsVacant", VACANT_RECODE)))
    out = clean.dedup(out, ["ParcelID", "PropertyAddress", "SaleDate", "SalePrice",
                            "LegalReference"], ["UniqueID"], keep="first")
    return clean.drop_columns(out, ["TaxDistrict", "OwnerAddress", "PropertyAddress", "SaleDate"])


def stage_shop_tables(raw: dict[str, DataFrame], review_order: str | None = None) -> dict[str, DataFrame]:
    """Raw e-commerce tables -> staging tables (each step a projection or
    an aggregate; tables missing from ``raw`` are skipped):

    * orders: trimmed ids, ``lower(trim(status))``, blank approval -> NULL, then
      a timestamp (text that is none is an error);
    * order_items: trimmed ids;
    * customers: trimmed text, one row per ``customer_unique_id`` (greatest
      ``customer_id`` kept);
    * products: trimmed id, blank category -> NULL, zero weight -> NULL;
    * product_category_name_translation: trimmed, completed with product
      categories it lacks (labelled by their own name);
    * reviews: trimmed ids, blank comments -> NULL, one row per
      ``review_id`` (greatest ``review_order`` kept);
    * payments: trimmed, zero instalments -> NULL;
    * sellers / geolocation: zip codes padded to 5 characters; geolocation
      reduced to one centroid per zip with accent-folded, lower-case city.
    """
    from ledgerline.operators import audit
    out: dict[str, DataFrame] = {}
    if "orders" in raw:
        o = raw["orders"]
        o = o.withColumn("order_id", F.trim("order_id")).withColumn("customer_id", F.trim("customer_id")) \
             .withColumn("order_status", text.trim_lower("order_status"))
        if dict(o.dtypes).get("order_approved_at") == "string":
            o = o.withColumn("order_approved_at",
                             text.blank_to_null("order_approved_at").cast("timestamp_ntz"))
        out["orders"] = o
    if "order_items" in raw:
        out["order_items"] = clean.normalize_strings(raw["order_items"],
                                                     trim=["order_id", "product_id", "seller_id"])
    if "customers" in raw:
        c = clean.normalize_strings(raw["customers"], trim=["customer_id", "customer_unique_id",
                                                             "customer_city", "customer_state"])
        out["customers"] = clean.dedup(c, ["customer_unique_id"], ["customer_id"], keep="last")
    if "products" in raw:
        p = raw["products"].withColumn("product_id", F.trim("product_id")) \
            .withColumn("product_category_name", text.blank_to_null("product_category_name"))
        out["products"] = clean.value_to_null(p, ["product_weight_g"], 0)
    if "product_category_name_translation" in raw:
        t = clean.normalize_strings(raw["product_category_name_translation"],
                                    trim=["product_category_name", "product_category_name_english"])
        if "products" in out:
            t = audit.complete_dimension(out["products"], t, "product_category_name",
                                         "product_category_name_english")
        out["product_category_name_translation"] = t
    if "reviews" in raw:
        r = raw["reviews"].withColumn("review_id", F.trim("review_id")) \
            .withColumn("order_id", F.trim("order_id"))
        for col in ("review_comment_title", "review_comment_message"):
            if col in r.columns:
                r = r.withColumn(col, text.blank_to_null(col))
        if review_order:
            r = clean.dedup(r, ["review_id"], [review_order], keep="last")
        out["reviews"] = r
    if "payments" in raw:
        pay = raw["payments"].withColumn("order_id", F.trim("order_id")) \
            .withColumn("payment_type", text.trim_lower("payment_type"))
        out["payments"] = clean.value_to_null(pay, ["payment_installments"], 0)
    if "sellers" in raw:
        s = raw["sellers"].withColumn("seller_id", F.trim("seller_id")) \
            .withColumn("seller_city", text.trim_lower("seller_city")) \
            .withColumn("seller_zip_code_prefix", text.pad_code("seller_zip_code_prefix", 5))
        out["sellers"] = s
    if "geolocation" in raw:
        g = raw["geolocation"].select(
            text.pad_code("geolocation_zip_code_prefix", 5).alias("geolocation_zip_code_prefix"),
            "geolocation_lat", "geolocation_lng",
            text.fold_key("geolocation_city").alias("city"),
            F.col("geolocation_state").alias("state"))
        out["geolocation"] = g.groupBy("geolocation_zip_code_prefix").agg(
            F.avg("geolocation_lat").alias("latitude"), F.avg("geolocation_lng").alias("longitude"),
            F.max("city").alias("city"), F.max("state").alias("state"))
    return out
