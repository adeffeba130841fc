"""Logistic regression by iteratively reweighted least squares (M5).

Each step is one aggregation: the weighted Gram matrix and the gradient are
sums over all rows ((d + 1)(d + 2) / 2 + d + 1 numbers for d features), combined
before the shuffle; the driver solves a system of d + 1 equations. Around ten
steps reach the optimum to machine precision, whatever the number of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.numeric import sigmoid
from ledgerline.operators.sequence import discard, materialize

INTERCEPT = "intercept"


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
                 l2: float = 1.0, max_steps: int = 25, tolerance: float = 1e-10) -> dict[str, float]:
    """Coefficients by term, ``intercept`` first, that minimise the weighted log
    loss plus ``l2 / 2`` times the squared coefficients (not the intercept).
    Rows that lack the label, the weight or a feature are left out."""
    terms = [f"_x{i}" for i in range(len(features))]
    rows = df.select(F.col(label).cast("double").alias("_y"),
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"),
                     *[F.col(c).cast("double").alias(t) for c, t in zip(features, terms)]).dropna()
    rows = materialize(rows, "glm-rows")
    d = len(features) + 1
    x = [F.lit(1.0)] + [F.col(t) for t in terms]
    beta = np.zeros(d)
    ridge = np.diag([0.0] + [float(l2)] * (d - 1))
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    for _ in range(max_steps):
        p = sigmoid(sum((F.lit(float(b)) * c for b, c in zip(beta[1:], x[1:])), F.lit(float(beta[0]))))
        step = rows.withColumn("_p", p).withColumn("_v", F.col("_w") * F.col("_p") * (1 - F.col("_p")))
        got = step.agg(*[F.sum(F.col("_v") * x[i] * x[j]) for i, j in pairs],
                       *[F.sum(F.col("_w") * (F.col("_y") - F.col("_p")) * c) for c in x]).first()
        if got[0] is None:
            break  # no rows
        gram = np.zeros((d, d))
        for (i, j), v in zip(pairs, got):
            gram[i, j] = gram[j, i] = v
        change = np.linalg.lstsq(gram + ridge, np.array(got[len(pairs):]) - ridge @ beta, rcond=None)[0]
        beta = beta + change
        if np.abs(change).max() <= tolerance * max(1.0, np.abs(beta).max()):
            break
    discard(rows)
    return dict(zip([INTERCEPT, *features], beta.tolist()))


def coefficients(spark, fitted: Mapping[str, float], digits: int = 4) -> DataFrame:
    """(term, coefficient, odds_ratio), one row per term."""
    table = spark.createDataFrame([(k, float(v)) for k, v in fitted.items()], "term string, coefficient double")
    return table.select("term", F.round("coefficient", digits).alias("coefficient"),
                        F.round(F.exp("coefficient"), digits).alias("odds_ratio"))
