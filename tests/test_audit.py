from pyspark.sql import functions as F

from ledgerline.operators import audit
from tests.conftest import rows


def test_duplicate_keys_composite(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (None, 3), (None, 3)], "a int, b int")
    assert rows(audit.duplicate_keys(df, ["a", "b"])) == [(1, 1, 2), (None, 3, 2)]


def test_orphans_and_labels(spark):
    items = spark.createDataFrame([(1, "p1"), (2, "p9"), (9, "p1"), (9, "p9")], "o int, p string")
    orders = spark.createDataFrame([(1,), (2,), (2,)], "o int")
    prods = spark.createDataFrame([("p1",)], "p string")
    assert rows(audit.orphans(items, orders, "o")) == [(9, "p1"), (9, "p9")]
    lab = audit.orphans_labelled(items, [("Missing Order", orders, "o", "o"),
                                         ("Missing Product", prods, "p", "p")])
    assert rows(lab) == [(2, "p9", "Missing Product"), (9, "p1", "Missing Order"),
                         (9, "p9", "Missing Order")]


def test_missing_members_null_aware(spark):
    child = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "c string")
    dim = spark.createDataFrame([("a",)], "c string")
    assert rows(audit.missing_members(child, dim, "c")) == [("b",), ("c",)]
    dim_null = spark.createDataFrame([("a",), (None,)], "c string")
    assert audit.missing_members(child, dim_null, "c").count() == 0
    full = audit.complete_dimension(child, dim.withColumn("label", F.lit("A")), "c", "label")
    assert rows(full) == [("a", "A"), ("b", "b"), ("c", "c")]


def test_violations_and_null_audit(spark):
    df = spark.createDataFrame([(1, -1, 400), (2, 5, None), (3, 5, 10)], "id int, w int, h int")
    v = audit.violations(df, {"negative": F.col("w") < 0, "too_tall": F.col("h") > 300}, ["id"])
    assert rows(v) == [(1, "negative"), (1, "too_tall")]
    na = audit.null_audit(df, ["w", "h"]).first()
    assert (na["total_rows"], na["missing_w"], na["missing_h"]) == (3, 0, 1)


def test_inconsistent_pattern_histogram(spark):
    df = spark.createDataFrame([("z1", "sp", "SP"), ("z1", "sao paulo", "SP"), ("z2", "rio", "RJ"),
                                ("z3", None, None)], "z string, city string, st string")
    assert rows(audit.inconsistent_attributes(df, "z", ["city", "st"])) == [("z1", 2, 1)]
    assert rows(audit.pattern_audit(df, "city", "[^\\x00-\\x7F]")) == []
    h = audit.value_histogram(df, "st")
    assert dict(rows(h))[None] == 0       # NULL group counts 0


def test_reconcile_counts(spark):
    a = spark.range(10)
    b = spark.range(7)
    assert rows(audit.reconcile_counts(a, b)) == [(10, 7, 3)]


def test_dedup_counts_one_pass(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    assert rows(audit.dedup_counts(df)) == [(5, 3, 2)]
    assert rows(audit.dedup_counts(df, ["k"])) == [(5, 3, 2)]
