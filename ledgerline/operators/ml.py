"""Tabular model jobs on ``pyspark.ml``.

Data preparation (split, weights, scaling, upsampling) is plain DataFrame
work and reproducible; trainers are ``pyspark.ml`` estimators, whose
``fit`` runs distributed tree/gradient aggregations.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.fixed_values import BAND_CUTS, BAND_LABELS
from ledgerline.functions.numeric import sigmoid
from ledgerline.operators.sequence import expand_range, global_row_number, materialize


def _class_stats(df: DataFrame, label: str) -> DataFrame:
    """One row per class: count and first global position."""
    return df.groupBy(F.col(label).alias("_cl")).agg(F.count(F.lit(1)).alias("_nc"),
                                                     F.min("_rn").alias("_first"))


def position_in_class(df: DataFrame, label: str, key: str) -> DataFrame:
    """0-based position of each row inside its class, ordered by
    ``md5(key)`` then ``key`` (a reproducible shuffle), plus the class size.
    Uses exact distributed numbering, so a majority class holding most
    rows is not a single window task."""
    order = [F.col(label).asc_nulls_first(), F.md5(F.col(key).cast("string")).asc(),
             F.col(key).asc()]
    n = global_row_number(df, order, "_rn")
    stats = _class_stats(n, label)
    return n.join(stats, F.col(label).eqNullSafe(F.col("_cl"))) \
            .withColumn("_pos", F.col("_rn") - F.col("_first")).drop("_rn", "_first", "_cl")


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                     name: str = "split") -> DataFrame:
    """Per class, the first ceil(test_fraction * n) rows of the md5 order are
    'test', the rest 'train' (deterministic, class shares preserved)."""
    p = position_in_class(df, label, key)
    n_test = F.ceil(F.col("_nc") * F.lit(test_fraction))
    return p.withColumn(name, F.when(F.col("_pos") < n_test, "test").otherwise("train")) \
            .drop("_pos", "_nc")


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """``class_weight='balanced'``: w = n / (k * n_class), for any number of
    classes (a NULL label is a class). The counts are staged, so that the join
    can split a class that holds most rows."""
    counts = materialize(df.groupBy(F.col(label).alias("_cl")).agg(F.count(F.lit(1)).alias("_nc")),
                         "class-counts")
    mean = counts.agg(F.sum("_nc").cast("double") / F.count(F.lit(1))).scalar()
    weights = counts.select("_cl", (mean / F.col("_nc")).alias(name))
    return df.join(weights, F.col(label).eqNullSafe(F.col("_cl"))).drop("_cl")


def fit_standardizer(train: DataFrame, cols: Sequence[str]) -> dict:
    """Mean and population standard deviation per feature, fitted on
    ``train`` in one aggregation: {col: (mean, std)}."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}")]
    row = train.agg(*aggs).first()
    return {c: (row[f"mu_{c}"], row[f"sd_{c}"]) for c in cols}


def standardize(df: DataFrame, params: Mapping, cols: Sequence[str],
                prefix: str = "z_") -> DataFrame:
    """(x - mean) / std with fitted parameters (a zero std gives NULL)."""
    out = df
    for c in cols:
        mu, sd = params[c]
        z = F.try_divide(F.col(c) - F.lit(mu), F.lit(sd)) if sd else F.lit(None).cast("double")
        out = out.withColumn(prefix + c, z)
    return out


def linear_score(df: DataFrame, intercept: float, weights: Mapping[str, float],
                 logit: str = "logit", score: str = "score") -> DataFrame:
    """Batch scoring with known coefficients: z = b + sum(w_i * x_i),
    score = 1 / (1 + exp(-z))."""
    z = F.lit(float(intercept))
    for c, w in weights.items():
        z = z + F.lit(float(w)) * F.col(c)
    return df.withColumn(logit, z).withColumn(score, sigmoid(F.col(logit)))


def upsample_minority(df: DataFrame, label: str, key: str, name: str = "copy_no") -> DataFrame:
    """Deterministic upsampling: every class is brought to the size N of the
    largest; row i (0-based, md5 order) of a class with m rows is repeated
    floor(N/m) + (1 if i < N mod m else 0) times."""
    big = df.groupBy(label).count().agg(F.max("count")).scalar()
    p = position_in_class(df, label, key).withColumn("_big", big)
    reps = F.floor(F.col("_big") / F.col("_nc")) + \
        F.when(F.col("_pos") < F.col("_big") % F.col("_nc"), 1).otherwise(0)
    out = expand_range(p.withColumn("_reps", reps), F.lit(1), F.col("_reps"), name)
    return out.withColumn(name, F.col(name).cast("int")).drop("_pos", "_nc", "_reps", "_big")


def value_band(c: Column | str, cuts: tuple[float, float] = BAND_CUTS,
               labels: tuple[str, str, str] = BAND_LABELS) -> Column:
    """Three bands: below cuts[0], cuts[0]..cuts[1] inclusive, above cuts[1]."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col < cuts[0], labels[0]).when(col <= cuts[1], labels[1]) \
            .when(col > cuts[1], labels[2])


def compare_to_baseline(df: DataFrame, label: str, cols: Sequence[str], baseline_label=0,
                        prefix: str = "delta_") -> DataFrame:
    """Each row's features minus the mean of the baseline class (means
    fitted in one aggregation)."""
    row = df.filter(F.col(label) == baseline_label).agg(
        *[(F.sum(c).cast("double") / F.count(c)).alias(c) for c in cols]).first()
    out = df
    for c in cols:
        out = out.withColumn(prefix + c, F.col(c) - F.lit(row[c]).cast("double"))
    return out


def class_balance(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


# --- trainers ----------------------------------------------------------------

def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def one_hot_drop_first(df: DataFrame, col: str, levels: Sequence | None = None,
                       prefix: str | None = None, base=None) -> DataFrame:
    """``get_dummies(drop_first=True)``: the alphabetically first level is the
    one without a column, NULL has zeros.

    With ``levels`` (those that get a column), one 0/1 column for each, in one
    projection; with ``base``, the level without one, any further level is an
    error, for it could not be told from the base. Without ``levels``, a sparse
    vector ``<prefix>vec`` of any length."""
    prefix = prefix or col + "_"
    if levels is not None:
        value = F.col(col)
        if base is not None:
            known = value.isNull() | value.isin(*levels, base)
            value = F.when(known, value).otherwise(F.raise_error(F.concat(
                F.lit(f"{col} has a level without a column: "), value.cast("string"))))
        return df.select("*", *[F.coalesce(value == F.lit(v), F.lit(False)).cast("int")
                                .alias(prefix + str(v)) for v in levels])
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = StringIndexer(inputCol=col, outputCol="_idx", stringOrderType="alphabetDesc",
                        handleInvalid="keep").fit(df)
    coded = idx.transform(df)
    enc = OneHotEncoder(inputCols=["_idx"], outputCols=[prefix + "vec"], dropLast=True,
                        handleInvalid="keep").fit(coded)
    return enc.transform(coded).drop("_idx")


def train_predict(train: DataFrame, test: DataFrame, estimator, features: Sequence[str],
                  label: str, keep: Sequence[str], weight: str | None = None,
                  partition_rows: int | None = None) -> DataFrame:
    """Fit ``estimator`` on ``train`` and score ``test``: keep columns, the
    predicted class and P(class 1).

    Iterative trainers scan their input once per iteration, so the
    assembled training rows are persisted (memory, spilling to disk) for
    the duration of ``fit``; a lost executor's blocks are rebuilt from the
    lineage. ``estimator`` may be a callable receiving the persisted frame
    (for parameters that depend on the data, such as a total weight).

    With ``partition_rows``, the training rows are staged and dealt evenly to
    partitions of about so many rows: an iteration is a job of its own, and for
    a few rows a task its time is that of starting the tasks."""
    from pyspark import StorageLevel
    from pyspark.ml.functions import vector_to_array
    if weight is None and hasattr(estimator, "isSet") and estimator.hasParam("weightCol") \
            and estimator.isSet("weightCol"):
        weight = estimator.getWeightCol()
    cols = list(dict.fromkeys([label, *features] + ([weight] if weight else [])))
    rows = train.select(*cols)
    if partition_rows:
        rows = materialize(rows, "training-rows")
        rows = rows.repartition(max(1, -(-rows.count() // partition_rows)))
    tr = assemble(rows, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        est = estimator(tr) if callable(estimator) and not hasattr(estimator, "fit") else estimator
        model = est.setFeaturesCol("features").setLabelCol(label).fit(tr)
    finally:
        tr.unpersist()
    scored = model.transform(assemble(test, features))
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                         vector_to_array("probability")[1].alias("probability"))
