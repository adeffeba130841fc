"""Language ID and quality: held-out accuracy, edge rows, parts by hand."""

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import op1_language_id as op1
from ledgerline.llm import op5_quality as op5

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = op1.op1_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right >= 0.97
    assert got.filter("score < 0 or score > 1").count() == 0
    assert got.filter("held_out != (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0


def test_language_edges(spark, docs, nothing):
    model = op1.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    got = op1.with_language(docs, model)
    assert got.columns == [c for c in docs.columns if c not in ("lang_pred", "score")] + ["lang_pred", "score", "ambiguous"]
    by = {r.d: r for r in got.collect()}
    assert len(by) == docs.count()
    none = [r for r in by.values() if not r.text or not any(c.isalpha() for c in r.text)]
    assert len(none) >= 4 and all(r.lang_pred == "und" and r.score == 0 and r.ambiguous for r in none)
    assert all(r.lang_pred in model["names"] for r in by.values() if r not in none)
    assert op1.with_language(nothing, model).count() == 0
    assert op1.learn(nothing)["names"] == []
    assert {r.lang_pred for r in op1.with_language(docs, op1.learn(nothing)).collect()} == {"und"}
    kept = op1.keep_identified(spark, docs, "")
    assert kept.columns == docs.columns and kept.filter("text is null or trim(text) = ''").count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(i, f"some words {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    got = op1.with_language(docs, op1.learn(docs)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("en", 1.0)}


def test_codewords_correct_errors():
    for k in (2, 4, 7, 20):
        code = op1.codewords(k)
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(k) * 99
        assert apart.min() >= (1 if k == 2 else 2 ** (k - 2) if k <= 7 else 12)


def test_decoding_outvotes_a_wrong_bit():
    code = op1.codewords(5)
    out = code * 2.0
    out[:, 3] *= -0.5  # one bit wrong, with less confidence
    model = {"code": code, "weights": np.vstack([np.eye(code.shape[1]), np.zeros(code.shape[1])])}
    best, score, gap = op1.decode(out, model)
    assert best.tolist() == list(range(5)) and (score > 0.5).all() and (gap > 0).all()


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op5.op5_quality(spark, SF).join(labels, "doc_id").filter("held_out").collect()
    good = np.array([r.score for r in got if r.quality == 1])
    bad = np.array([r.score for r in got if r.quality == 0])
    assert (good[:, None] > bad[None]).mean() > 0.95
    assert all(r.predicted == int(r.score >= 0.7) for r in got)


def test_quality_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, quality int")
    model = op5.learn(docs, labels)
    got = op5.with_quality(docs.drop("score"), model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert op5.with_quality(nothing, model).count() == 0
    assert {r.score for r in op5.with_quality(docs, op5.learn(docs, labels.limit(0))).collect()} == {0.5}


def test_flat_trees_equal_walked_trees():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    model = op5.fit(x, y, trees=12, depth=3)
    for row, p in zip(x[:50], op5.predict(x[:50], model)):
        total = model["base"]
        for f, t, v in zip(model["feature"], model["threshold"], model["value"]):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node]
        assert abs(p - 1 / (1 + np.exp(-total))) < 1e-12
    assert ((op5.predict(x, model) > 0.5) == y).mean() > 0.9
