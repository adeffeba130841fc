from pyspark.sql import functions as F

from ledgerline.operators import clean
from tests.conftest import rows


def test_normalize_strings(spark):
    df = spark.createDataFrame([(" A ", " DeLiVeRed ", "  "), ("b", "x", None)], "a string, s string, c string")
    out = clean.normalize_strings(df, trim=["a"], lower=["s"], blank_to_null=["c"])
    assert rows(out) == [("A", "delivered", None), ("b", "x", None)]


def test_value_to_null(spark):
    df = spark.createDataFrame([(1, 0), (2, 5)], "k int, w int")
    assert rows(clean.value_to_null(df, ["w"], 0)) == [(1, None), (2, 5)]


def test_dedup_exact_nulls_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1)], "c string, n int")
    assert rows(clean.dedup_exact(df)) == [("a", None), ("b", 1)]


def test_dedup_exact_folded(spark):
    df = spark.createDataFrame([("Zoë", 1), ("ZOE", 1), ("zoe ", 1), ("Ann", 1)], "c string, n int")
    out = clean.dedup_exact(df, fold=["c"])
    assert out.count() == 2
    assert rows(out) == [("Ann", 1), ("ZOE", 1)]   # smallest original kept


def test_dedup_first_last(spark):
    df = spark.createDataFrame([("u1", 3), ("u1", 9), ("u2", 5), (None, 1), (None, 2)], "u string, id int")
    assert rows(clean.dedup(df, ["u"], ["id"], "last")) == [("u1", 9), ("u2", 5), (None, 2)]
    assert rows(clean.dedup(df, ["u"], ["id"], "first")) == [("u1", 3), ("u2", 5), (None, 1)]


def test_duplicate_rows(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "c string")
    assert rows(clean.duplicate_rows(df)) == [("a", 2), ("a", 3)]


def test_fill_from_group_donors(spark):
    df = spark.createDataFrame(
        [(1, "p0", None),            # no donor
         (2, "p1", None), (3, "p1", "X"),                 # one donor
         (4, "p2", None), (5, "p2", "B"), (6, "p2", "A"),  # two donors: smallest id wins
         (7, None, None), (8, None, "N"),                 # NULL keys never match
         (9, "p3", ""), (10, "p3", "Q")],                  # blank counts as missing
        "id int, k string, v string")
    out = clean.fill_from_group(df, "k", "v", "id")
    got = dict(rows(out, "id", "v"))
    assert got[1] is None and got[2] == "X" and got[4] == "B" and got[7] is None
    assert got[9] == "Q"
    prev = clean.donor_preview(df, "k", "v", "id", show=["id"])
    assert rows(prev, "id", "donor_value", "donor_count") == [
        (1, None, 0), (2, "X", 1), (4, "B", 2), (7, None, 0), (9, "Q", 1)]


def test_drop_unmeasured_keeps_null_predicate(spark):
    df = spark.createDataFrame([(None, None), (1, None), (None, "0.5")], "a int, b string")
    assert rows(clean.drop_unmeasured(df, ["a", "b"])) == [(1, None), (None, "0.5")]


def test_fill_from_group_folded_keys(spark):
    df = spark.createDataFrame([(1, "Bally's", None), (2, "BALLY’S", None), (3, "bally's", "Gaming")],
                               "id int, k string, v string")
    out = dict(rows(clean.fill_from_group(df, "k", "v", "id", fold=True), "id", "v"))
    assert out == {1: "Gaming", 2: None, 3: "Gaming"}   # curly apostrophe is a different key
    plain = dict(rows(clean.fill_from_group(df, "k", "v", "id"), "id", "v"))
    assert plain[1] is None
