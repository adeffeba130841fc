import pytest
from pyspark.sql import functions as F

from ledgerline.operators import metrics, ml
from tests.conftest import rows


def _labelled(spark, n_pos=16, n_neg=84):
    data = [(i, 1 if i < n_pos else 0, float(i % 10), float(i % 7)) for i in range(n_pos + n_neg)]
    return spark.createDataFrame(data, "id long, y int, x1 double, x2 double")


def test_stratified_split_preserves_shares(spark):
    s = ml.stratified_split(_labelled(spark), "y", "id", 0.2)
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got == {(1, "test"): 4, (1, "train"): 12, (0, "test"): 17, (0, "train"): 67}
    again = ml.stratified_split(_labelled(spark), "y", "id", 0.2)
    assert rows(s, "id", "split") == rows(again, "id", "split")   # deterministic


def test_balanced_weights(spark):
    w = {r["y"]: r["weight"] for r in ml.balanced_weights(_labelled(spark), "y").collect()}
    assert abs(w[1] - 100 / (2 * 16)) < 1e-12 and abs(w[0] - 100 / (2 * 84)) < 1e-12


def test_upsample_minority_counts(spark):
    up = ml.upsample_minority(_labelled(spark, 5, 12), "y", "id")
    counts = {r["y"]: r["count"] for r in up.groupBy("y").count().collect()}
    assert counts == {0: 12, 1: 12}
    per_row = sorted(r["count"] for r in up.filter("y = 1").groupBy("id").count().collect())
    assert per_row == [2, 2, 2, 3, 3]


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    z = ml.standardize(df, ml.fit_standardizer(df, ["x"]), ["x"])
    assert sorted(r["z_x"] for r in z.collect()) == [-1.0, 1.0]


def test_value_band_edges(spark):
    df = spark.createDataFrame([(34,), (35,), (55,), (56,), (None,)], "age int")
    got = dict(rows(df.select("age", ml.value_band("age").alias("b"))))
    assert got == {34: "Young", 35: "Middle", 55: "Middle", 56: "Senior", None: None}


def test_report_zero_denominator_and_auc_ties(spark):
    df = spark.createDataFrame([(1, 0, 0.5, 1), (0, 0, 0.5, 2), (0, 0, 0.1, 3), (1, 0, 0.9, 4)],
                               "y int, p int, s double, id int")
    rep = {r["class"]: r for r in metrics.report(df, "y", "p").collect()}
    assert rep["1"]["precision"] == 0.0 and rep["1"]["recall"] == 0.0 and rep["1"]["f1_score"] == 0.0
    assert rep["accuracy"]["f1_score"] == 0.5
    # brute force AUC: P(score_pos > score_neg) + 0.5 P(tie)
    pos, neg = [0.5, 0.9], [0.5, 0.1]
    brute = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / 4
    assert abs(metrics.auc(df, "y", "s", "id").first()["auc"] - brute) < 1e-9


def test_group_fpr_null_without_negatives(spark):
    df = spark.createDataFrame([("a", 1, 1), ("b", 0, 1), ("b", 0, 0)], "g string, y int, p int")
    got = {r["g"]: r["fpr"] for r in metrics.group_fpr(df, "y", "p", "g").collect()}
    assert got == {"a": None, "b": 0.5}


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([("de",), ("en",), ("fr",), ("en",)], "lang string")
    out = ml.one_hot_drop_first(df, "lang", ["en", "fr"])
    assert set(out.columns) == {"lang", "lang_en", "lang_fr"}
    assert rows(out, "lang", "lang_en", "lang_fr") == [("de", 0, 0), ("en", 1, 0), ("en", 1, 0),
                                                       ("fr", 0, 1)]


def test_logistic_regression_trains(spark):
    from pyspark.ml.classification import LogisticRegression
    df = ml.balanced_weights(_labelled(spark), "y")
    out = ml.train_predict(df, df, LogisticRegression(weightCol="weight"), ["x1", "x2"], "y", ["id"])
    assert out.count() == 100 and set(out.columns) == {"id", "prediction", "probability"}


def test_any_number_of_classes_and_levels(spark):
    df = spark.range(12000).selectExpr("id", "cast(id % 11000 as string) as cid")
    weights = {r["weight"] for r in ml.balanced_weights(df, "cid").collect()}
    assert weights == {12000 / 11000, 12000 / 22000}
    vec = ml.one_hot_drop_first(df, "cid").select("cid_vec").first()[0]
    assert len(vec) >= 10999
    assert ml.upsample_minority(df, "cid", "id").count() == 22000


def test_null_label_is_a_class(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(40)], "id int, y int")
    assert ml.stratified_split(df, "y", "id").count() == 40
    assert ml.balanced_weights(df, "y").filter("weight is null").count() == 0
    assert {r["y"]: r["count"] for r in ml.upsample_minority(df, "y", "id").groupBy("y").count().collect()} \
        == {None: 16, 0: 16, 1: 16}


def test_one_hot_refuses_a_level_that_is_neither_listed_nor_the_base(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, c string")
    got = ml.one_hot_drop_first(df, "c", ["b"], base="a")
    assert sorted((r.id, r.c_b) for r in got.collect()) == [(1, 0), (2, 1), (3, 0)]
    more = df.unionByName(spark.createDataFrame([(4, "z")], "id int, c string"))
    with pytest.raises(Exception, match="without a column: z"):
        ml.one_hot_drop_first(more, "c", ["b"], base="a").collect()


def test_training_rows_are_dealt_to_partitions_of_the_asked_size(spark):
    """An iteration is a job: a few rows in many partitions take the time of their tasks."""
    from pyspark.ml.classification import LogisticRegression
    df = _labelled(spark, 300, 700).repartition(40)
    seen = []

    def estimator(persisted):
        seen.append((persisted.rdd.getNumPartitions(), persisted.count()))
        return LogisticRegression(maxIter=2)
    for size in (4000, 300):
        out = ml.train_predict(df, df, estimator, ["x1", "x2"], "y", ["id"], partition_rows=size)
        assert out.count() == 1000
    assert seen == [(1, 1000), (4, 1000)]


def test_the_network_trains_on_sized_partitions(spark, monkeypatch):
    from ledgerline.plans import models
    sizes = []
    monkeypatch.setattr(models.ml, "train_predict", lambda *a, **k: sizes.append(k["partition_rows"]))
    models.mlp(spark, "/root/testdata/sf0.001")
    assert sizes == [models.NETWORK_ROWS]
