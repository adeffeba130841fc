import datetime as dt

from pyspark.sql import functions as F

from ledgerline.functions import (accent_fold, blank_to_null, fold_key, pad_code, parse_date,
                                  ratio_pct, recode, recode_prefix, seconds_between,
                                  shift_months, sigmoid, split_first, split_right,
                                  strip_trailing, week_start)


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_split_first_head_tail(spark):
    df = spark.createDataFrame([("1808  FOX CHASE DR, GOODLETTSVILLE",), ("NO COMMA",),
                                ("a, b, c",), (None,)], "v string")
    h, t = split_first("v")
    got = {r["v"]: (r["h"], r["t"]) for r in df.select("v", h.alias("h"), t.alias("t")).collect()}
    assert got["1808  FOX CHASE DR, GOODLETTSVILLE"] == ("1808  FOX CHASE DR", " GOODLETTSVILLE")
    assert got["NO COMMA"] == (None, "NO COMMA")       # head NULL, tail whole string
    assert got["a, b, c"] == ("a", " b, c")            # first comma only
    assert got[None] == (None, None)


def test_split_right_parsename(spark):
    df = spark.createDataFrame([("A, B, C",), ("A, B",), ("1, 2, 3, 4, 5",), (None,), ("A,,C",)],
                               "v string")
    out = df.select("v", *[split_right("v", n).alias(f"p{n}") for n in (1, 2, 3)]).collect()
    got = {r["v"]: (r["p3"], r["p2"], r["p1"]) for r in out}
    assert got["A, B, C"] == ("A", " B", " C")
    assert got["A, B"] == (None, "A", " B")
    assert got["1, 2, 3, 4, 5"] == (None, None, None)  # more than four parts -> NULL
    assert got[None] == (None, None, None)
    assert got["A,,C"] == ("A", None, "C")             # empty part -> NULL


def test_accent_fold_and_fold_key(spark):
    assert one(spark, accent_fold("v"), "São Paulo 4º Centenário") == "Sao Paulo 4º Centenario"
    assert one(spark, fold_key("v"), "  Élan VITAL ") == "elan vital"
    assert one(spark, accent_fold("v"), "Ñandú Über çà") == "Nandu Uber ca"


def test_blank_pad_recode(spark):
    assert one(spark, blank_to_null("v"), "   ") is None
    assert one(spark, pad_code("v", 5), "1234") == "01234"
    assert one(spark, pad_code("v", 5), "1234567") == "12345"   # LPAD truncates
    assert one(spark, recode("v", {"Y": "Yes", "N": "No"}), "Y") == "Yes"
    assert one(spark, recode("v", {"Y": "Yes", "N": "No"}), "Maybe") == "Maybe"
    assert one(spark, recode("v", {"Y": "Yes"}), None) is None


def test_recode_prefix_and_strip(spark):
    assert one(spark, recode_prefix("v", "Crypto", "Crypto"), "Crypto Currency") == "Crypto"
    assert one(spark, recode_prefix("v", "Crypto", "Crypto"), "crypto") == "crypto"
    assert one(spark, recode_prefix("v", "Crypto", "Crypto", fold=True), "crÿpto x") == "Crypto"
    assert one(spark, recode_prefix("v", "Crypto", "Crypto", fold=True), "cryp to") == "cryp to"
    assert one(spark, recode_prefix("v", "Crypto", "Crypto", fold=True), "CRYPTO x") == "Crypto"
    us = strip_trailing("v", ".", "United States")
    assert one(spark, us, "United States..") == "United States"
    assert one(spark, us, "Other.") == "Other."


def test_dates(spark):
    assert one(spark, parse_date("v"), "3/6/2023") == dt.date(2023, 3, 6)
    assert one(spark, parse_date("v"), "12/31/2022") == dt.date(2022, 12, 31)
    assert one(spark, parse_date("v"), "not a date") is None
    ts = spark.createDataFrame([(dt.datetime(2023, 3, 9, 10, 0),)], "t timestamp_ntz")
    r = ts.select(week_start("t").alias("w"), shift_months("t", 3).alias("m"),
                  seconds_between(F.col("t") + F.expr("INTERVAL 1 DAY"), "t").alias("s")).first()
    assert r["w"] == dt.datetime(2023, 3, 6)   # Monday
    assert r["m"] == dt.datetime(2022, 12, 9, 10, 0)
    assert r["s"] == 86400


def test_ratio_and_sigmoid(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0)], "a double, b double")
    got = [r["p"] for r in df.select(ratio_pct("a", "b").alias("p")).collect()]
    assert got == [None, None, 25.0]
    assert abs(one(spark, sigmoid(F.col("v")), 0.0, "v double") - 0.5) < 1e-12


def test_calendar_starts_ignore_session_zone(spark):
    from ledgerline.functions import day_start, month_start
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        df = spark.createDataFrame([(dt.datetime(2018, 11, 4, 12, 0),)], "t timestamp_ntz")
        r = df.select(day_start("t").alias("d"), month_start("t").alias("m"),
                      week_start("t").alias("w")).first()
        assert (r["d"], r["m"], r["w"]) == (dt.datetime(2018, 11, 4), dt.datetime(2018, 11, 1),
                                            dt.datetime(2018, 10, 29))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_seconds_between_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
        df = spark.createDataFrame([(dt.datetime(2001, 10, 14), dt.datetime(1997, 6, 11))],
                                   "a timestamp_ntz, b timestamp_ntz")
        assert df.select(seconds_between("a", "b").alias("s")).first()["s"] == 1586 * 86400
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_accent_fold_beyond_composed_letters(spark):
    df = spark.createDataFrame([("Sa\u0303o Łódź", "Straße", "Øre œuf")], "a string, b string, c string")
    got = df.select(*[accent_fold(c) for c in ("a", "b", "c")]).first()
    assert tuple(got) == ("Sao Lodz", "Strasse", "Ore oeuf")


def test_recode_prefix_folds_both_sides(spark):
    df = spark.createDataFrame([("Ação x",), ("acao y",), ("z",)], "a string")
    got = [r[0] for r in df.select(recode_prefix("a", "Ação", "hit", fold=True)).collect()]
    assert got == ["hit", "hit", "z"]
