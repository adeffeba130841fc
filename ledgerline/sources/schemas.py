"""Declared schemas (S4) for the recipe inputs, so CSV/parquet sources are
read with explicit types instead of inference. Raw text stays ``string``
where a cleaning step does the parsing (dates as text, flags, numbers
stored as text)."""

from __future__ import annotations

from pyspark.sql import types as T


def _s(*fields: tuple[str, T.DataType] | tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


S, I, D, NTZ, DT = T.StringType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType(), T.DateType()
MONEY = T.DecimalType(10, 2)

# --- e-commerce (fixed by its DDL) -------------------------------------------
CUSTOMERS = _s(("customer_id", S, False), ("customer_unique_id", S, False),
               ("customer_zip_code_prefix", I), ("customer_city", S), ("customer_state", S))
GEOLOCATION = _s(("geolocation_zip_code_prefix", I), ("geolocation_lat", D),
                 ("geolocation_lng", D), ("geolocation_city", S), ("geolocation_state", S))
ORDERS = _s(("order_id", S, False), ("customer_id", S, False), ("order_status", S, False),
            ("order_purchase_timestamp", NTZ, False), ("order_approved_at", NTZ),
            ("order_delivered_carrier_date", NTZ), ("order_delivered_customer_date", NTZ),
            ("order_estimated_delivery_date", NTZ))
CATEGORY_TRANSLATION = _s(("product_category_name", S, False), ("product_category_name_english", S))
PRODUCTS = _s(("product_id", S, False), ("product_category_name", S), ("product_name_length", I),
              ("product_description_length", I), ("product_photos_qty", I), ("product_weight_g", I),
              ("product_length_cm", I), ("product_height_cm", I), ("product_width_cm", I))
SELLERS = _s(("seller_id", S, False), ("seller_zip_code_prefix", I), ("seller_city", S),
             ("seller_state", S))
ORDER_ITEMS = _s(("order_id", S, False), ("order_item_id", I, False), ("product_id", S, False),
                 ("seller_id", S, False), ("shipping_limit_date", NTZ), ("price", MONEY),
                 ("freight_value", MONEY))
REVIEWS = _s(("review_id", S, False), ("order_id", S, False), ("review_score", I, False),
             ("review_comment_title", S), ("review_comment_message", S),
             ("review_creation_date", NTZ, False), ("review_answer_timestamp", NTZ, False))
PAYMENTS = _s(("order_id", S, False), ("payment_sequential", I, False), ("payment_type", S, False),
              ("payment_installments", I, False), ("payment_value", MONEY, False))
CLEAN_GEOLOCATION = _s(("geolocation_zip_code_prefix", S), ("latitude", D), ("longitude", D),
                       ("city", S), ("state", S))

# --- epidemic (inferred from the casts the recipes apply) --------------------
COVID_DEATHS = _s(("continent", S), ("location", S), ("date", NTZ),
                  ("population", T.DecimalType(18, 0)), ("total_cases", D), ("new_cases", D),
                  ("total_deaths", S), ("new_deaths", S))
COVID_VACCINATIONS = _s(("location", S), ("date", NTZ), ("new_vaccinations", S),
                        ("total_vaccinations", D))
PERCENT_POP_VACCINATED = _s(("continent", S), ("location", S), ("date", NTZ),
                            ("population", T.DecimalType(18, 0)),
                            ("new_vaccinations", T.DecimalType(18, 0)),
                            ("rolling_people_vaccinated", T.DecimalType(18, 0)))

# --- housing, layoffs, credit ------------------------------------------------
HOUSING = _s(("UniqueID", I), ("ParcelID", S), ("PropertyAddress", S), ("SaleDate", NTZ),
             ("SalePrice", D), ("LegalReference", S), ("OwnerAddress", S), ("SoldAsVacant", S),
             ("TaxDistrict", S))
LAYOFFS = _s(("company", S), ("location", S), ("industry", S), ("total_laid_off", I),
             ("percentage_laid_off", S), ("date", S), ("stage", S), ("country", S),
             ("funds_raised_millions", I))
CREDIT = _s(("Customer_ID", S), ("Age", I), ("Income", D), ("Credit_Score", I),
            ("Credit_Utilization", D), ("Missed_Payments", I), ("Delinquent_Account", I),
            ("Debt_to_Income_Ratio", D), ("Employment_Status", S), ("Credit_Card_Type", S),
            ("Location", S), *[(f"Month_{i}", S) for i in range(1, 7)])

# --- driver tables (parquet physical types; timestamps are zone-less) --------
L, F32 = T.LongType(), T.FloatType()
DRIVER = {
    "region": _s(("r_regionkey", I), ("r_name", S)),
    "nation": _s(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _s(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                   ("c_mktsegment", S)),
    "supplier": _s(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _s(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
               ("p_retailprice", D)),
    "orders": _s(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                 ("o_orderdate", NTZ), ("o_orderpriority", S)),
    "lineitem": _s(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                   ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                   ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", NTZ)),
    "events": _s(("event_id", L), ("ts", NTZ), ("user_id", L), ("event_type", S), ("value", D),
                 ("props", S)),
    "documents": _s(("doc_id", L), ("text", S), ("lang", S), ("source", S), ("n_chars", L)),
    "embeddings": _s(("vec_id", L), ("embedding", T.ArrayType(F32)), ("label", I)),
    "pages": _s(("page_id", L), ("url", S), ("html", S)),
    "benchmark": _s(("item_id", L), ("text", S)),
    "labels": _s(("doc_id", L), ("quality", I), ("toxic", I)),
    "conversations": _s(("conv_id", L), ("turn", L), ("role", S), ("text", S)),
}
