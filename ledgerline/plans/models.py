"""Model jobs on labelled documents.

Stand-in: label = ``labels.toxic`` (imbalanced, like the delinquency flag),
features computed from the whole document text (characters, lines,
words), group attributes ``lang`` and a band of the line count. The
"scored" table for the metrics predicts toxic when ``quality = 0``.
Trainer outputs (random draws, solver internals) are checked by rows only.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import fixed_values as fv
from ledgerline.operators import glm, metrics, ml, trees
from ledgerline.operators.sequence import materialize
from ledgerline.sources.tables import load

FEATURES = ["n_chars", "n_lines", "n_words"]
WORD_SPLIT = "[ \t\n\r]+"
TEST_FRACTION = Decimal(fv.TEST_FRACTION)
SCORE_INTERCEPT = -2.0
SCORE_WEIGHTS = {"n_chars": 0.0001, "n_lines": 0.01, "n_words": 0.001}
BAND_CUTS = fv.BAND_CUTS
TREE_DEPTH = 3


def feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    lab = load(spark, sf, "labels")
    doc = load(spark, sf, "documents")
    j = lab.join(doc, "doc_id")
    # parts of a split = separators + 1; counted without building arrays
    n_lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    n_words = F.regexp_count("text", F.lit(WORD_SPLIT)) + 1
    return j.select("doc_id", F.col("toxic").alias("label"), "quality", "lang", "source",
                    "n_chars", n_lines.cast("int").alias("n_lines"),
                    n_words.cast("int").alias("n_words"))


def labelled(spark, sf) -> DataFrame:
    """The labelled documents as narrow rows (doc_id, label): the numbering
    jobs below never touch the texts (only ``doc_id`` is read from
    ``documents``)."""
    lab = load(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    docs = load(spark, sf, "documents").select("doc_id")
    return lab.join(docs, "doc_id", "left_semi")


def split_keys(spark, sf) -> DataFrame:
    return ml.stratified_split(labelled(spark, sf), "label", "doc_id", TEST_FRACTION)


def split_frame(spark, sf) -> DataFrame:
    """Features with their split; text features are computed once, after
    the split is fixed."""
    return feature_frame(spark, sf).join(split_keys(spark, sf).drop("label"), "doc_id")


def staged_split_frame(spark, sf) -> DataFrame:
    """``split_frame`` written once as narrow rows: jobs that read their input
    several times (fit, training rows, scoring) read each text once."""
    return materialize(split_frame(spark, sf), "features")


def stratified_split(spark, sf):
    return split_keys(spark, sf).select("doc_id", "label", "split")


def balanced_weights(spark, sf):
    train = split_frame(spark, sf).filter(F.col("split") == "train")
    return ml.balanced_weights(train, "label").select("doc_id", "label", "weight")


def _standardized(spark, sf) -> DataFrame:
    s = staged_split_frame(spark, sf)
    stats = ml.fit_standardizer(s.filter(F.col("split") == "train"), FEATURES)
    return ml.standardize(s, stats, FEATURES)


def standardize(spark, sf):
    z = _standardized(spark, sf)
    return z.select("doc_id", "split", *[F.round("z_" + c, 6).alias("z_" + c) for c in FEATURES])


def linear_score(spark, sf):
    f = ml.linear_score(feature_frame(spark, sf), SCORE_INTERCEPT, SCORE_WEIGHTS)
    return f.select("doc_id", F.round("logit", 9).alias("logit"), F.round("score", 9).alias("score"))


def one_hot_lang(spark, sf):
    f = ml.one_hot_drop_first(feature_frame(spark, sf), "lang", LANGS, base=BASE_LANG)
    return f.drop("label", "quality", "lang", "source", *FEATURES)


def upsample_minority(spark, sf):
    return ml.upsample_minority(labelled(spark, sf), "label", "doc_id") \
             .select("doc_id", "label", "copy_no")


def value_band(spark, sf):
    f = feature_frame(spark, sf)
    return f.select("doc_id", "n_lines", ml.value_band("n_lines", BAND_CUTS).alias("band"))


def compare_to_safe_mean(spark, sf):
    f = materialize(feature_frame(spark, sf), "features")
    f = ml.compare_to_baseline(f, "label", FEATURES, 0)
    return f.select("doc_id", *["delta_" + c for c in FEATURES])


def class_balance(spark, sf):
    return ml.class_balance(feature_frame(spark, sf), "label")


# --- trainers (rows-only checks) ----------------------------------------------

LANGS, BASE_LANG = ["en", "es", "fr"], "de"  # levels of lang with a 0/1 column, and without
LANG_FEATURES = ["lang_" + v for v in LANGS]
NETWORK_ROWS = 1 << 15  # training rows of the network in a partition


def _weighted_train_test(rows):
    train = ml.balanced_weights(rows.filter(F.col("split") == "train"), "label")
    test = rows.filter(F.col("split") == "test")
    return train, test


def logistic_regression(spark, sf):
    from pyspark.ml.classification import LogisticRegression
    train, test = _weighted_train_test(_standardized(spark, sf))

    def estimator(persisted):
        # sklearn's C=1 with an averaged loss: regParam = 1 / sum(weights)
        total_w = persisted.agg(F.sum("weight")).first()[0] or 1.0
        return LogisticRegression(weightCol="weight", regParam=1.0 / total_w,
                                  elasticNetParam=0.0, standardization=False,
                                  maxIter=100)  # sklearn's default max_iter
    return ml.train_predict(train, test, estimator, ["z_" + c for c in FEATURES], "label",
                            ["doc_id", "label"], weight="weight")


def decision_tree(spark, sf):
    from pyspark.ml.classification import DecisionTreeClassifier
    train, test = _weighted_train_test(staged_split_frame(spark, sf))
    est = DecisionTreeClassifier(maxDepth=3, weightCol="weight", seed=42)
    return ml.train_predict(train, test, est, FEATURES, "label", ["doc_id", "label"],
                            weight="weight")


def random_forest(spark, sf):
    from pyspark.ml.classification import RandomForestClassifier
    rows = ml.one_hot_drop_first(staged_split_frame(spark, sf), "lang", LANGS, base=BASE_LANG)
    train, test = _weighted_train_test(rows)
    est = RandomForestClassifier(numTrees=100, maxDepth=30,  # Spark's limit
                                 weightCol="weight", seed=42)
    return ml.train_predict(train, test, est, FEATURES + LANG_FEATURES, "label", ["doc_id", "label"],
                            weight="weight")


def mlp(spark, sf):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    z = ml.one_hot_drop_first(_standardized(spark, sf), "lang", LANGS, base=BASE_LANG)
    features = ["z_" + c for c in FEATURES] + LANG_FEATURES
    copies = ml.upsample_minority(z.filter(F.col("split") == "train").select("doc_id", "label"), "label", "doc_id")
    train = copies.select("doc_id", "copy_no").join(z.drop("split"), "doc_id")
    test = z.filter(F.col("split") == "test")
    est = MultilayerPerceptronClassifier(layers=[len(features), 16, 2], maxIter=1000, seed=42)
    return ml.train_predict(train, test, est, features, "label", ["doc_id", "label"],
                            partition_rows=NETWORK_ROWS)


# --- metrics -----------------------------------------------------------------

def scored(spark, sf) -> DataFrame:
    f = feature_frame(spark, sf)
    return f.withColumn("prediction", (F.col("quality") == 0).cast("int"))


def confusion_matrix(spark, sf):
    return metrics.confusion(scored(spark, sf), "label", "prediction")


def classification_report(spark, sf):
    return metrics.report(scored(spark, sf), "label", "prediction")


def roc_auc(spark, sf):
    return metrics.auc(scored(spark, sf), "label", "n_lines", "doc_id")


def group_fpr(spark, sf):
    return metrics.group_fpr(scored(spark, sf), "label", "prediction", "lang")


def fpr_by_band(spark, sf):
    s = scored(spark, sf).withColumn("band", ml.value_band("n_lines", BAND_CUTS))
    return metrics.group_fpr(s, "label", "prediction", "band")


# --- models as tables and expressions -------------------------------------------

def _fitted_tree(spark, sf):
    rows = staged_split_frame(spark, sf)
    train = rows.filter(F.col("split") == "train")
    return rows, train, trees.fit(train, FEATURES, "label", TREE_DEPTH)


def decision_tree_rules(spark, sf):
    """The tree's rules with their support among the training rows."""
    _, train, tree = _fitted_tree(spark, sf)
    return trees.rules(train, tree, "label")


def decision_tree_scored(spark, sf):
    """The test rows scored by the tree as one CASE expression."""
    rows, _, tree = _fitted_tree(spark, sf)
    number = trees.expression(tree, lambda leaf, n: n)
    return rows.filter(F.col("split") == "test").select(
        "doc_id", "label", trees.expression(tree).alias("prediction"), number.alias("rule_no"))


def decision_tree_metrics(spark, sf):
    return metrics.report(decision_tree_scored(spark, sf), "label", "prediction")


def _fitted_logistic(spark, sf):
    z = _standardized(spark, sf)
    train, test = _weighted_train_test(z)
    return glm.fit_logistic(train, ["z_" + c for c in FEATURES], "label", "weight"), test


def logistic_coefficients(spark, sf):
    fitted, _ = _fitted_logistic(spark, sf)
    return glm.coefficients(spark, fitted)


def logistic_scored(spark, sf):
    """The test rows scored with the fitted coefficients."""
    fitted, test = _fitted_logistic(spark, sf)
    weights = {k: v for k, v in fitted.items() if k != glm.INTERCEPT}
    out = ml.linear_score(test, fitted[glm.INTERCEPT], weights)
    return out.select("doc_id", "label", F.round("score", 6).alias("score"),
                      (F.col("score") > 0.5).cast("int").alias("prediction"))


def logistic_metrics(spark, sf):
    return metrics.report(logistic_scored(spark, sf), "label", "prediction")


QUERIES = {
    "decision_tree_rules": decision_tree_rules,
    "decision_tree_scored": decision_tree_scored,
    "decision_tree_metrics": decision_tree_metrics,
    "logistic_coefficients": logistic_coefficients,
    "logistic_scored": logistic_scored,
    "logistic_metrics": logistic_metrics,
    "feature_frame": feature_frame,
    "stratified_split": stratified_split,
    "balanced_weights": balanced_weights,
    "standardize": standardize,
    "linear_score": linear_score,
    "one_hot_lang": one_hot_lang,
    "upsample_minority": upsample_minority,
    "value_band": value_band,
    "compare_to_safe_mean": compare_to_safe_mean,
    "class_balance": class_balance,
    "logistic_regression": logistic_regression,
    "decision_tree": decision_tree,
    "random_forest": random_forest,
    "mlp": mlp,
    "confusion_matrix": confusion_matrix,
    "classification_report": classification_report,
    "roc_auc": roc_auc,
    "group_fpr": group_fpr,
    "fpr_by_band": fpr_by_band,
}

_FEAT = """
feat AS (
  SELECT d.doc_id, l.toxic AS label, l.quality, d.lang, d.source, d.n_chars,
         CAST(len(string_split(d.text, chr(10))) AS INTEGER) AS n_lines,
         CAST(len(regexp_split_to_array(d.text, '[ \\t\\n\\r]+')) AS INTEGER) AS n_words
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
sp AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY label
                                         ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1
                      < ceil(COUNT(*) OVER (PARTITION BY label) * 0.2)
                 THEN 'test' ELSE 'train' END AS split
  FROM feat),
sc AS (SELECT *, CAST(quality = 0 AS INTEGER) AS prediction FROM feat),
cm AS (SELECT CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp,
              CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS fp,
              CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS fn,
              CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS tn
       FROM sc)
"""


def _w(body: str) -> str:
    return "WITH " + _FEAT + body


def _fpr(group: str) -> str:
    return f"""
SELECT {group}, CAST(count_if(label = 0 AND prediction = 1) + count_if(label = 0 AND prediction = 0) AS BIGINT)
         AS negatives,
       round(CAST(count_if(label = 0 AND prediction = 1) AS DOUBLE)
             / NULLIF(count_if(label = 0 AND prediction = 1) + count_if(label = 0 AND prediction = 0), 0), 6) AS fpr
FROM g GROUP BY {group}"""


_BAND = "CASE WHEN n_lines < 35 THEN 'Young' WHEN n_lines <= 55 THEN 'Middle' WHEN n_lines > 55 THEN 'Senior' END"

SQL = {
"feature_frame": _w("SELECT * FROM feat"),
"stratified_split": _w("SELECT doc_id, label, split FROM sp"),
"balanced_weights": _w("""
, tr AS (SELECT * FROM sp WHERE split = 'train'),
c AS (SELECT label, COUNT(*) AS nc FROM tr GROUP BY label)
SELECT tr.doc_id, tr.label,
       CAST((SELECT COUNT(*) FROM tr) AS DOUBLE) / ((SELECT COUNT(*) FROM c) * c.nc) AS weight
FROM tr JOIN c ON tr.label = c.label"""),
"standardize": _w("""
, st AS (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(n_lines) AS m2,
                stddev_pop(n_lines) AS s2, avg(n_words) AS m3, stddev_pop(n_words) AS s3
         FROM sp WHERE split = 'train')
SELECT doc_id, split, round((n_chars - m1) / NULLIF(s1, 0), 6) AS z_n_chars,
       round((n_lines - m2) / NULLIF(s2, 0), 6) AS z_n_lines,
       round((n_words - m3) / NULLIF(s3, 0), 6) AS z_n_words
FROM sp, st"""),
"linear_score": _w("""
, z AS (SELECT doc_id, CAST(-2.0 AS DOUBLE) + CAST(0.0001 AS DOUBLE) * n_chars + CAST(0.01 AS DOUBLE) * n_lines
                      + CAST(0.001 AS DOUBLE) * n_words AS logit FROM feat)
SELECT doc_id, round(logit, 9) AS logit, round(CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-logit)), 9) AS score FROM z"""),
"one_hot_lang": _w("""
SELECT doc_id, CAST(lang = 'en' AS INTEGER) AS lang_en, CAST(lang = 'es' AS INTEGER) AS lang_es,
       CAST(lang = 'fr' AS INTEGER) AS lang_fr FROM feat"""),
"upsample_minority": _w("""
, p AS (SELECT doc_id, label,
               row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos,
               COUNT(*) OVER (PARTITION BY label) AS nc FROM feat),
q AS (SELECT *, MAX(nc) OVER () AS big FROM p),
r AS (SELECT *, CAST(floor(big / nc) + CASE WHEN pos < big % nc THEN 1 ELSE 0 END AS INTEGER) AS reps FROM q)
SELECT doc_id, label, CAST(g.copy_no AS INTEGER) AS copy_no
FROM r, LATERAL (SELECT unnest(range(1, reps + 1)) AS copy_no) g"""),
"value_band": _w(f"SELECT doc_id, n_lines, {_BAND} AS band FROM feat"),
"compare_to_safe_mean": _w("""
, m AS (SELECT CAST(SUM(n_chars) AS DOUBLE) / COUNT(n_chars) AS m1,
               CAST(SUM(n_lines) AS DOUBLE) / COUNT(n_lines) AS m2,
               CAST(SUM(n_words) AS DOUBLE) / COUNT(n_words) AS m3 FROM feat WHERE label = 0)
SELECT doc_id, n_chars - m1 AS delta_n_chars, n_lines - m2 AS delta_n_lines,
       n_words - m3 AS delta_n_words FROM feat, m"""),
"class_balance": _w("""
SELECT label, COUNT(*) AS n, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () AS share
FROM feat GROUP BY label"""),
"confusion_matrix": _w("SELECT tp, fp, fn, tn FROM cm"),
"classification_report": _w("""
, per AS (
  SELECT '1' AS class, COALESCE(tp / NULLIF(tp + fp, 0), 0) AS p, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS r,
         tp + fn AS support FROM cm
  UNION ALL
  SELECT '0', COALESCE(tn / NULLIF(tn + fn, 0), 0), COALESCE(tn / NULLIF(tn + fp, 0), 0), tn + fp FROM cm),
per2 AS (SELECT *, COALESCE(2 * p * r / NULLIF(p + r, 0), 0) AS f1 FROM per),
alls AS (
  SELECT class, p, r, f1, support FROM per2
  UNION ALL SELECT 'accuracy', NULL, NULL, COALESCE((tp + tn) / NULLIF(tp + tn + fp + fn, 0), 0),
                   tp + tn + fp + fn FROM cm
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), SUM(support) FROM per2
  UNION ALL SELECT 'weighted avg', SUM(p * support) / SUM(support), SUM(r * support) / SUM(support),
                   SUM(f1 * support) / SUM(support), SUM(support) FROM per2)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM alls"""),
"roc_auc": _w("""
, r AS (SELECT label, rank() OVER (ORDER BY n_lines) AS lo, COUNT(*) OVER (PARTITION BY n_lines) AS c FROM sc),
a AS (SELECT SUM(CASE WHEN label = 1 THEN lo + (c - 1) / 2.0 ELSE 0 END) AS r1,
             SUM(label) AS n1, COUNT(*) - SUM(label) AS n0 FROM r)
SELECT round((r1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 9) AS auc FROM a"""),
"group_fpr": _w(", g AS (SELECT * FROM sc)" + _fpr("lang")),
"fpr_by_band": _w(f", g AS (SELECT *, {_BAND} AS band FROM sc)" + _fpr("band")),
}


def _report_of(table: str) -> str:
    """The classification report over (label, prediction) of ``table``."""
    return f"""
, per AS (
  SELECT CAST(c AS VARCHAR) AS class, count_if(label = c AND prediction = c) AS hit,
         count_if(prediction = c) AS said, count_if(label = c) AS support
  FROM {table}, (SELECT unnest([0, 1]) AS c) GROUP BY c),
rates AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM per),
scores AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM rates),
alls AS (
  SELECT class, p, r, f, support FROM scores
  UNION ALL SELECT 'accuracy', NULL, NULL, sum(hit) / sum(support), sum(support) FROM scores
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), sum(support) FROM scores
  UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                   sum(f * support) / sum(support), sum(support) FROM scores)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score,
       CAST(support AS BIGINT) AS support FROM alls"""


def _tree_sql(depth: int) -> str:
    """CTEs ``node0`` to ``node<depth>``: the training rows' nodes (the root is 1,
    below node k are 2 k and 2 k + 1), and ``split<i>``, the splits of level i."""
    feats = " UNION ALL ".join(
        f"SELECT node, {i} AS f, CAST({c} AS DOUBLE) AS v, label FROM node{{d}}" for i, c in enumerate(FEATURES))
    chosen = "CASE s.f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(FEATURES)) + " END"
    out = f"""
, cw AS (SELECT count(*) / (2 * nullif(count_if(label = 0), 0)) AS w0, count(*) / (2 * nullif(count_if(label = 1), 0)) AS w1
         FROM sp WHERE split = 'train'),
node0 AS (SELECT doc_id, label, {', '.join(FEATURES)}, 1 AS node FROM sp WHERE split = 'train')"""
    for d in range(depth):
        out += f""",
long{d} AS ({feats.format(d=d)}),
vals{d} AS (SELECT node, f, v, count_if(label = 0) AS c0, count_if(label = 1) AS c1 FROM long{d} GROUP BY node, f, v),
cum{d} AS (
  SELECT node, f, v, sum(c0) OVER w AS l0, sum(c1) OVER w AS l1, sum(c0) OVER (PARTITION BY node, f) AS n0,
         sum(c1) OVER (PARTITION BY node, f) AS n1, lead(v) OVER (PARTITION BY node, f ORDER BY v) AS nxt
  FROM vals{d} WINDOW w AS (PARTITION BY node, f ORDER BY v)),
imp{d} AS (
  SELECT node, f, v, nxt, l0 * w0 AS a, l1 * w1 AS b, (n0 - l0) * w0 AS x, (n1 - l1) * w1 AS y
  FROM cum{d}, cw WHERE nxt IS NOT NULL AND n0 > 0 AND n1 > 0),
split{d} AS (
  SELECT node, f, (v + nxt) / 2 AS t FROM imp{d}
  QUALIFY row_number() OVER (PARTITION BY node ORDER BY (a * a + b * b) / (a + b) + (x * x + y * y) / (x + y) DESC, f, v) = 1),
node{d + 1} AS (
  SELECT r.doc_id, r.label, {', '.join('r.' + c for c in FEATURES)}, 2 * r.node + (CASE WHEN {chosen} <= s.t THEN 0 ELSE 1 END) AS node
  FROM node{d} r JOIN split{d} s ON r.node = s.node)"""
    splits = " UNION ALL ".join(f"SELECT * FROM split{d}" for d in range(depth))
    ends = " UNION ALL ".join(
        f"SELECT node, label FROM node{d}" + (f" WHERE node NOT IN (SELECT node FROM split{d})" if d < depth else "")
        for d in range(depth + 1))
    names = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURES)) + " END"
    text = "CAST(CAST(t AS DECIMAL(20, 4)) AS VARCHAR)"
    return out + f""",
splits AS ({splits}),
leaf AS (
  SELECT node, count_if(label = 0) AS c0, count_if(label = 1) AS c1 FROM ({ends}) GROUP BY node),
steps AS (
  SELECT leaf.node, k, s.node AS above, (leaf.node >> k) % 2 AS side, {names} AS name, t, {text} AS said
  FROM leaf, range(0, {depth}) g(k), splits s WHERE (leaf.node >> (k + 1)) = s.node),
paths AS (
  SELECT node, string_agg(name || CASE WHEN side = 0 THEN ' <= ' ELSE ' > ' END || said, ' AND ' ORDER BY k DESC) AS rule,
         string_agg(CAST(side AS VARCHAR), '' ORDER BY k DESC) AS turns
  FROM steps GROUP BY node),
ruled AS (
  SELECT CAST(row_number() OVER (ORDER BY turns) AS INTEGER) AS rule_no, coalesce(rule, 'true') AS rule,
         CASE WHEN c1 * w1 > c0 * w0 THEN 1 ELSE 0 END AS class, c0 + c1 AS support,
         CASE WHEN c1 * w1 > c0 * w0 THEN c1 ELSE c0 END AS hits, leaf.node
  FROM leaf LEFT JOIN paths USING (node), cw)"""


def _tree_scored(depth: int) -> str:
    """Test rows walked down the splits."""
    chosen = "CASE s.f " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(FEATURES)) + " END"
    out = ",\ntest0 AS (SELECT *, 1 AS node FROM sp WHERE split = 'test')"
    for d in range(depth):
        out += f""",
test{d + 1} AS (
  SELECT r.* EXCLUDE (node), CASE WHEN s.node IS NULL THEN r.node WHEN {chosen} <= s.t THEN 2 * r.node ELSE 2 * r.node + 1 END AS node
  FROM test{d} r LEFT JOIN splits s ON r.node = s.node)"""
    return out + f""",
told AS (SELECT doc_id, label, class AS prediction, rule_no FROM test{depth} JOIN ruled USING (node))"""


def _newton_sql(steps: int) -> str:
    """CTEs ``b0`` to ``b<steps>``: coefficients after so many Newton steps, each
    from sums over the weighted training rows and Gaussian elimination."""
    d = len(FEATURES) + 1
    z = ["1.0"] + [f"x{i}" for i in range(1, d)]
    out = """
, st AS (SELECT """ + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(FEATURES, 1)) + """
         FROM sp WHERE split = 'train'),
nc AS (SELECT label, count(*) AS n FROM sp WHERE split = 'train' GROUP BY label),
zs AS (SELECT sp.doc_id, sp.label, sp.split, (SELECT sum(n) FROM nc) / ((SELECT count(*) FROM nc) * nc.n) AS w, """ +         ", ".join(f"({c} - m{i}) / nullif(s{i}, 0) AS x{i}" for i, c in enumerate(FEATURES, 1)) + """
       FROM sp JOIN nc USING (label), st),
tr AS MATERIALIZED (SELECT * FROM zs WHERE split = 'train'),
b0 AS (SELECT """ + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(d)) + ")"
    for s in range(steps):
        line = " + ".join(["b0"] + [f"b{i} * x{i}" for i in range(1, d)])
        sums = [f"sum(w * p * (1 - p) * {z[i]} * {z[j]}) + {int(i == j and i > 0)} AS a{i}{j}" for i in range(d) for j in range(i, d)]
        sums += [f"sum(w * (label - p) * {z[i]}) - {int(i > 0)} * any_value(b{i}) AS g{i}" for i in range(d)]
        out += f""",
p{s} AS (SELECT *, 1 / (1 + exp(-({line}))) AS p FROM tr, b{s}),
e{s}_0 AS (SELECT {', '.join(sums)}, {', '.join(f'any_value(b{i}) AS b{i}' for i in range(d))} FROM p{s})"""
        for k in range(d - 1):  # row k out of the rows below it
            cols = [f"a{i}{j}" for i in range(k + 1) for j in range(i, d)] + [f"g{i}" for i in range(k + 1)]
            cols += [f"a{i}{j} - a{k}{i} * a{k}{j} / a{k}{k} AS a{i}{j}" for i in range(k + 1, d) for j in range(i, d)]
            cols += [f"g{i} - a{k}{i} * g{k} / a{k}{k} AS g{i}" for i in range(k + 1, d)]
            out += f",\ne{s}_{k + 1} AS (SELECT {', '.join(cols + [f'b{i}' for i in range(d)])} FROM e{s}_{k})"
        back = []
        for i in reversed(range(d)):
            rest = "".join(f" - a{i}{j} * d{j}" for j in range(i + 1, d))
            back.append(f"(g{i}{rest}) / a{i}{i} AS d{i}")
        out += f""",
b{s + 1} AS (SELECT {', '.join(f'b{i} + d{i} AS b{i}' for i in range(d))} FROM (SELECT *, {', '.join(back)} FROM e{s}_{d - 1}))"""
    return out


_NEWTON = 12
_LOGIT = " + ".join(["b0"] + [f"b{i} * x{i}" for i in range(1, len(FEATURES) + 1)])
_SCORED = f""",
told AS (SELECT doc_id, label, 1 / (1 + exp(-({_LOGIT}))) AS score, CAST(1 / (1 + exp(-({_LOGIT}))) > 0.5 AS INTEGER) AS prediction
         FROM zs, b{_NEWTON} WHERE split = 'test')"""

SQL.update({
    "decision_tree_rules": _w(_tree_sql(TREE_DEPTH) + "\nSELECT rule_no, rule, class, CAST(support AS BIGINT) AS support, CAST(hits AS BIGINT) AS hits FROM ruled"),
    "decision_tree_scored": _w(_tree_sql(TREE_DEPTH) + _tree_scored(TREE_DEPTH) +
                               "\nSELECT doc_id, label, prediction, rule_no FROM told"),
    "decision_tree_metrics": _w(_tree_sql(TREE_DEPTH) + _tree_scored(TREE_DEPTH) + _report_of("told")),
    "logistic_coefficients": _w(_newton_sql(_NEWTON) + f"""
SELECT term, round(b, 4) AS coefficient, round(exp(b), 4) AS odds_ratio
FROM (SELECT unnest(['intercept', {', '.join(f"'z_{c}'" for c in FEATURES)}]) AS term,
             unnest([{', '.join(f'b{i}' for i in range(len(FEATURES) + 1))}]) AS b FROM b{_NEWTON})"""),
    "logistic_scored": _w(_newton_sql(_NEWTON) + _SCORED + "\nSELECT doc_id, label, round(score, 6) AS score, prediction FROM told"),
    "logistic_metrics": _w(_newton_sql(_NEWTON) + _SCORED + _report_of("told")),
})
