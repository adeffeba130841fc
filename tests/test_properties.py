"""Property tests: Column helpers and distributed numbering against small
pure-Python references on generated inputs (one Spark job per example
batch, so example counts stay modest)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.functions import pad_code, split_first, split_right
from ledgerline.operators.sequence import global_row_number

TEXT = st.lists(st.text(alphabet="ab ,.", max_size=12) | st.none(), min_size=1, max_size=25)


def ref_split_first(s):
    if s is None:
        return None, None
    i = s.find(",")
    return (s[:i] if i >= 0 else None), (s[i + 1:] if i >= 0 else s)


def ref_parsename(s, n):
    if s is None:
        return None
    parts = s.replace(",", ".").split(".")
    if len(parts) > 4 or n > len(parts):
        return None
    p = parts[-n]
    return p if p != "" else None


@settings(max_examples=15, deadline=None)
@given(TEXT)
def test_split_helpers_match_reference(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    h, t = split_first("s")
    out = df.select("i", "s", h.alias("h"), t.alias("t"),
                    *[split_right("s", n).alias(f"p{n}") for n in (1, 2, 3)]).collect()
    for r in out:
        assert (r["h"], r["t"]) == ref_split_first(r["s"])
        for n in (1, 2, 3):
            assert r[f"p{n}"] == ref_parsename(r["s"], n)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=10**7), min_size=1, max_size=30))
def test_pad_code_matches_lpad(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r["z"] for r in df.select(pad_code("v", 5).alias("z")).collect()]
    assert got == [str(v).rjust(5, "0")[:5] for v in values]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=3), min_size=1, max_size=200),
       st.integers(min_value=1, max_value=6))
def test_global_row_number_any_shape(spark, values, parts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v long")
    order = [F.col("v").asc(), F.col("id").desc()]
    got = {r["id"]: r["rn"] for r in global_row_number(df, order, "rn", parts).collect()}
    ref = {r["id"]: r["rn"] for r in
           df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rn")).collect()}
    assert got == ref
