"""Running totals, sliding windows, basket pairs and models against brute
force, with a group that holds a third of all rows."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import commerce, glm, ml, sequence, timeseries, trees
from tests.conftest import rows


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(5)
    data = [(i, "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, "c"]),
             None if rnd.random() < 0.05 else rnd.randint(0, 60), None if rnd.random() < 0.1 else rnd.randint(-5, 9))
            for i in range(3000)]
    data += [(9000 + i, "empty", i, None) for i in range(3)]
    return spark.createDataFrame(data, "id long, k string, t int, v long").repartition(7, "id")


def _plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("by", [["k"], []])
def test_running_sums_equal_the_range_frame(hot, by):
    got = timeseries.running_total(hot, "v", "t", by=by, name="r")
    w = Window.partitionBy(*by).orderBy("t") if by else Window.orderBy("t")
    # the operator replaces nothing but adds r; peers share totals, NULLs come first
    want = hot.withColumn("r", F.sum("v").over(w))
    assert rows(got, "id", "k", "t", "v", "r") == rows(want, "id", "k", "t", "v", "r")
    assert "SinglePartition" not in _plan(got)


def test_running_sums_over_many_range_partitions(hot):
    got = sequence.running_sums(hot, {"r": "v"}, ["t", "id"], ["k"], partitions=40)
    want = hot.withColumn("r", F.sum("v").over(Window.partitionBy("k").orderBy("t", "id")))
    assert rows(got, "id", "r") == rows(want, "id", "r")


def test_running_sums_keep_decimals_and_empty_input(spark, hot):
    money = hot.select("id", "k", "t", F.col("v").cast("decimal(18,2)").alias("v"))
    got = sequence.running_sums(money, {"r": "v"}, ["t"], ["k"])
    assert got.schema["r"].dataType.simpleString() == "decimal(28,2)"
    assert sequence.running_sums(money.limit(0), {"r": "v"}, ["t"], ["k"]).count() == 0


def test_sliding_windows_cross_blocks(hot):
    order = [F.col("t").asc_nulls_first(), F.col("id").asc()]
    w = Window.orderBy("t", "id")
    got = sequence.sliding(hot, order, 6, lambda x: {"m": F.avg("v").over(x.rowsBetween(-6, 0)), "p": F.lag("v").over(x)},
                           block_rows=50)
    want = hot.withColumn("m", F.avg("v").over(w.rowsBetween(-6, 0))).withColumn("p", F.lag("v").over(w))
    assert rows(got, "id", "m", "p") == rows(want, "id", "m", "p")
    with pytest.raises(ValueError):
        sequence.sliding(hot, order, 50, lambda x: {}, block_rows=50)


def test_growth_and_moving_average_of_raw_rows_equal_the_series_form(hot):
    for f in (lambda s: timeseries.growth(hot, "v", ["t", "id"], "p", "g", series=s),
              lambda s: timeseries.moving_average(hot, "v", ["t", "id"], 7, "g", series=s)):
        assert rows(f(False), "id", "g") == rows(f(True), "id", "g")


def test_pairs_of_a_basket_with_a_third_of_the_lines(spark):
    rnd = random.Random(3)
    lines = [(0, i % 230) for i in range(700)] + [(1 + rnd.randint(0, 300), rnd.randint(0, 40)) for _ in range(1400)]
    lines += [(None, 1), (None, 2), (5, None)]
    df = spark.createDataFrame(lines, "b int, i int")
    per = Counter(x for x in lines if None not in x)
    want = Counter()
    for b in {b for b, _ in per}:
        items = sorted(i for c, i in per if c == b)
        for x, y in combinations(items, 2):
            want[x, y] += per[b, x] * per[b, y]
    for block in (7, 1000):
        got = commerce.pair_counts(df, "b", "i", block_items=block)
        assert {(r.item_1, r.item_2): r.pair_count for r in got.collect()} == want


def test_a_block_pair_is_the_largest_key_of_the_basket_join(spark):
    """The join's keys of a huge basket hold about block_items rows a side."""
    df = spark.range(4000).select(F.lit(1).alias("b"), F.col("id").alias("i"))
    got = commerce.pair_counts(df, "b", "i", block_items=200)
    assert got.agg(F.count("*"), F.sum("pair_count")).first() == (4000 * 3999 // 2, 4000 * 3999 // 2)
    join = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join Inner" in line]
    assert any("_i" in line and "_j" in line for line in join)


# -- models -----------------------------------------------------------------
@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(9)
    data = []
    for i in range(600):
        a, b, c = rnd.gauss(0, 1), rnd.randint(0, 9), rnd.random()
        y = int(rnd.random() < 1 / (1 + math.exp(-(1.5 * a - 0.4 * b + 0.5))))
        data.append((i, a, b, c, y, 1.0 + (i % 3)))
    return spark.createDataFrame(data, "id long, a double, b int, c double, y int, w double")


def _cart(data, names, depth, w):
    """Plain CART: (feature, threshold, left, right) or class counts."""
    n = [sum(r["y"] == k for r in data) for k in (0, 1)]
    if depth == 0 or 0 in n:
        return tuple(n)

    def purity(rs):
        x, z = (sum(r["y"] == k for r in rs) * w[k] for k in (0, 1))
        return (x * x + z * z) / (x + z)
    best = None
    for f in names:
        values = sorted({r[f] for r in data})
        for v, after in zip(values, values[1:]):
            left, right = [r for r in data if r[f] <= v], [r for r in data if r[f] > v]
            s = purity(left) + purity(right)
            if best is None or s > best[0]:
                best = s, f, (v + after) / 2, left, right
    if best is None:
        return tuple(n)
    _, f, t, left, right = best
    return f, t, _cart(left, names, depth - 1, w), _cart(right, names, depth - 1, w)


def _shape(node):
    if node.left is None:
        return node.counts
    return node.feature, node.threshold, _shape(node.left), _shape(node.right)


def test_tree_equals_plain_cart_and_its_rules_cover_the_rows(labelled):
    tree = trees.fit(labelled, ["a", "b", "c"], "y", 3)
    data = [r.asDict() for r in labelled.collect()]
    n = [sum(r["y"] == k for r in data) for k in (0, 1)]
    assert _shape(tree) == _cart(data, ["a", "b", "c"], 3, [sum(n) / (2 * k) for k in n])
    table = trees.rules(labelled, tree, "y").collect()
    assert sum(r.support for r in table) == len(data)
    for r in table:
        assert labelled.filter(r.rule).count() == r.support
        assert labelled.filter(f"({r.rule}) AND y = {r['class']}").count() == r.hits


def test_tree_of_one_class_no_rows_and_missing_values(spark, labelled):
    one = trees.fit(labelled.filter("y = 1"), ["a", "b"], "y")
    assert one.left is None and one.prediction == 1
    nothing = trees.fit(labelled.limit(0), ["a"], "y")
    assert nothing.left is None
    holes = labelled.withColumn("a", F.when(F.col("id") % 5 == 0, None).otherwise(F.col("a")))
    tree = trees.fit(holes, ["a", "b"], "y")
    assert sum(sum(leaf.counts) for leaf, _ in trees.leaves(tree)) == holes.dropna().count()
    assert holes.select(trees.expression(tree).alias("p")).filter("p IS NULL").count() == 0


@pytest.mark.parametrize("categories", [False, True])
def test_expression_of_a_fitted_model_equals_the_model(labelled, categories):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler, VectorIndexer
    names = ["a", "b", "c"]
    v = VectorAssembler(inputCols=names, outputCol="raw").transform(labelled)
    v = VectorIndexer(inputCol="raw", outputCol="features", maxCategories=12 if categories else 2).fit(v).transform(v)
    model = DecisionTreeClassifier(labelCol="y", maxDepth=5, seed=1).fit(v)
    tree = trees.from_model(model, names)
    assert any(n.levels for n, _ in [(tree, ())]) or len(trees.leaves(tree)) > 3
    both = model.transform(v).select("prediction", trees.expression(tree).alias("mine"))
    assert both.filter("prediction <> mine").count() == 0


def test_weighted_least_squares_equals_the_library_model(labelled):
    from pyspark.ml.classification import LogisticRegression
    names = ["a", "b", "c"]
    mine = glm.fit_logistic(labelled, names, "y", "w")
    total = labelled.agg(F.sum("w")).first()[0]
    model = LogisticRegression(labelCol="y", weightCol="w", regParam=1 / total, elasticNetParam=0.0,
                               standardization=False, maxIter=500, tol=1e-12).fit(ml.assemble(labelled, names))
    assert mine["intercept"] == pytest.approx(model.intercept, abs=1e-5)
    assert [mine[n] for n in names] == pytest.approx(list(model.coefficients), abs=1e-5)


def test_weighted_least_squares_without_rows_or_with_holes(labelled):
    assert set(glm.fit_logistic(labelled.limit(0), ["a"], "y").values()) == {0.0}
    holes = labelled.withColumn("a", F.when(F.col("id") % 4 == 0, None).otherwise(F.col("a")))
    assert glm.fit_logistic(holes, ["a"], "y") == pytest.approx(glm.fit_logistic(holes.dropna(), ["a"], "y"))
