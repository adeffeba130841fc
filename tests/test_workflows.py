import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import workflows
from tests.conftest import rows

LAYOFF_SCHEMA = ("company string, location string, industry string, total_laid_off int, "
                 "percentage_laid_off string, date string, stage string, country string, "
                 "funds_raised_millions int")


def test_clean_layoffs(spark):
    raw = [
        (" Acme ", "SF", "Crypto Currency", 10, "0.5", "3/6/2023", "A", "United States.", 5),
        (" Acme ", "SF", "Crypto Currency", 10, "0.5", "3/6/2023", "A", "United States.", 5),  # dup
        ("Acme", "SF", "", 20, None, "12/31/2022", "B", "United States..", 5),  # blank, peer Crypto
        ("Solo", "NY", "", 5, "1", None, "C", "Peru.", None),                    # blank, no peer
        ("Gone", "LA", "Retail", None, None, "1/1/2023", "D", "Chile", 1),        # unmeasured
        (None, None, None, None, None, None, None, None, None),                  # all NULL x2
        (None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(raw, LAYOFF_SCHEMA)
    out = workflows.clean_layoffs(df)
    got = rows(out, "company", "industry", "date", "country", "total_laid_off")
    assert got == [("Acme", "Crypto", dt.date(2022, 12, 31), "United States", 20),
                   ("Acme", "Crypto", dt.date(2023, 3, 6), "United States", 10),
                   ("Solo", None, None, "Peru.", 5)]


def test_clean_housing(spark):
    raw = spark.createDataFrame([
        (1, "p1", "1 MAIN ST, NASHVILLE", dt.datetime(2019, 1, 2, 10), 100, "L1",
         "1 MAIN ST, NASHVILLE, TN", "Y", "T"),
        (2, "p1", None, dt.datetime(2019, 1, 3), 200, "L2", "1 MAIN ST, NASHVILLE", "N", "T"),
        (3, "p2", "NOCOMMA", dt.datetime(2019, 1, 4), 300, "L3", None, "Yes", "T"),
        (4, "p2", "NOCOMMA", dt.datetime(2019, 1, 4), 300, "L3", "a, b, c, d, e", "No", "T"),  # dup of 3
    ], "UniqueID int, ParcelID string, PropertyAddress string, SaleDate timestamp_ntz, "
       "SalePrice int, LegalReference string, OwnerAddress string, SoldAsVacant string, "
       "TaxDistrict string")
    out = workflows.clean_housing(raw)
    assert "PropertyAddress" not in out.columns and "TaxDistrict" not in out.columns
    got = {r["UniqueID"]: r for r in out.collect()}
    assert set(got) == {1, 2, 3}
    assert (got[2]["PropSplitAddress"], got[2]["PropSplitCity"]) == ("1 MAIN ST", " NASHVILLE")
    assert got[2]["OwnerSplitAddress"] is None and got[2]["OwnerSplitState"] == " NASHVILLE"
    assert (got[1]["OwnerSplitAddress"], got[1]["OwnerSplitState"]) == ("1 MAIN ST", " TN")
    assert (got[3]["PropSplitAddress"], got[3]["PropSplitCity"]) == (None, "NOCOMMA")
    assert got[1]["SoldAsVacant"] == "Yes" and got[2]["SoldAsVacant"] == "No"
    assert got[1]["SaleDateConverted"] == dt.date(2019, 1, 2)


def test_stage_shop_tables(spark):
    raw = {
        "orders": spark.createDataFrame([(" o1 ", " c1", " Delivered ", "")],
                                        "order_id string, customer_id string, order_status string, "
                                        "order_approved_at string"),
        "customers": spark.createDataFrame([("c1", "u1", "São Paulo ", "SP"), ("c2", "u1", "x", "SP")],
                                           "customer_id string, customer_unique_id string, "
                                           "customer_city string, customer_state string"),
        "products": spark.createDataFrame([("p1", "", 0), ("p2", "livros", 10)],
                                          "product_id string, product_category_name string, "
                                          "product_weight_g int"),
        "product_category_name_translation": spark.createDataFrame(
            [("moveis", "furniture")], "product_category_name string, product_category_name_english string"),
        "reviews": spark.createDataFrame([("r1", "o1", 5, "", 1), ("r1", "o1", 4, "ok", 2)],
                                         "review_id string, order_id string, review_score int, "
                                         "review_comment_message string, pos int"),
        "payments": spark.createDataFrame([("o1", "Boleto ", 0)],
                                          "order_id string, payment_type string, payment_installments int"),
        "geolocation": spark.createDataFrame([(1234, -23.0, -46.0, "São Paulo", "SP"),
                                              (1234, -25.0, -48.0, "sao paulo", "SP")],
                                             "geolocation_zip_code_prefix int, geolocation_lat double, "
                                             "geolocation_lng double, geolocation_city string, "
                                             "geolocation_state string"),
    }
    st = workflows.stage_shop_tables(raw, review_order="pos")
    o = st["orders"].first()
    assert (o["order_id"], o["customer_id"], o["order_status"], o["order_approved_at"]) == \
        ("o1", "c1", "delivered", None)
    assert rows(st["customers"], "customer_id") == [("c2",)]
    assert rows(st["products"], "product_id", "product_category_name", "product_weight_g") == \
        [("p1", None, None), ("p2", "livros", 10)]
    assert rows(st["product_category_name_translation"]) == [("livros", "livros"), ("moveis", "furniture")]
    assert rows(st["reviews"], "review_score", "review_comment_message") == [(4, "ok")]
    assert rows(st["payments"], "payment_type", "payment_installments") == [("boleto", None)]
    assert rows(st["geolocation"]) == [("01234", -24.0, -47.0, "sao paulo", "SP")]
