"""Classification metrics as DataFrame aggregates (M12-M15). Every metric
is one or two passes of partial aggregation; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.sequence import global_row_number, materialize


def _counts(df: DataFrame, label: str, pred: str):
    y, p = F.col(label) == 1, F.col(pred) == 1
    return [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
            F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]


def confusion(df: DataFrame, label: str, pred: str, by: str | None = None) -> DataFrame:
    g = df.groupBy(by) if by else df.groupBy()
    return g.agg(*_counts(df, label, pred))


def _safe(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def report(df: DataFrame, label: str, pred: str, digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class, plus accuracy, macro and
    weighted averages (a zero denominator gives 0)."""
    c = confusion(df, label, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    rows = []
    for cls, (tpc, fpc, fnc) in (("1", (tp, fp, fn)), ("0", (tn, fn, fp))):
        prec, rec = _safe(tpc, tpc + fpc), _safe(tpc, tpc + fnc)
        f1 = _safe(2 * prec * rec, prec + rec)
        rows.append(c.select(F.lit(cls).alias("class"), prec.alias("precision"),
                             rec.alias("recall"), f1.alias("f1_score"),
                             (tpc + fnc).alias("support")))
    per = rows[0].unionByName(rows[1])
    n = per.agg(F.sum("support")).scalar()
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
                    F.sum("support").alias("support"))
    wt = per.agg(
        F.lit("weighted avg").alias("class"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1_score") * F.col("support")) / n).alias("f1_score"),
        F.sum("support").alias("support"))
    acc = c.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"),
                   _safe(tp + tn, tp + tn + fp + fn).alias("f1_score"),
                   (tp + tn + fp + fn).alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(wt)
    return out.select("class", *[F.round(x, digits).alias(x) for x in
                                 ("precision", "recall", "f1_score")], "support")


def auc(df: DataFrame, label: str, score: str, key: str) -> DataFrame:
    """ROC AUC by Mann-Whitney: positives' average ranks (ties share the mean
    rank). Ranks come from exact distributed numbering, so no single task
    sorts the whole table. The narrow (label, score, key) rows are staged
    once first: range partitioning samples its input in a separate job,
    which would otherwise recompute an expensive score (e.g. a text
    feature) a second time."""
    # a row without a label is neither positive nor negative
    narrow = materialize(df.select(label, score, key).filter(F.col(label).isNotNull()), "auc-input")
    n = global_row_number(narrow, [F.col(score).asc_nulls_first(), F.col(key).asc()], "_rn")
    per = n.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_pos"),
                               F.count(F.lit(1)).alias("_c"),
                               F.min("_rn").alias("_lo"), F.max("_rn").alias("_hi"))
    tot = per.agg(F.sum(F.col("_pos") * (F.col("_lo") + F.col("_hi")) / 2).alias("_r1"),
                  F.sum("_pos").alias("_n1"), (F.sum("_c") - F.sum("_pos")).alias("_n0"))
    val = (F.col("_r1") - F.col("_n1") * (F.col("_n1") + 1) / 2) / (F.col("_n1") * F.col("_n0"))
    return tot.select(F.round(val, 9).alias("auc"))


def group_fpr(df: DataFrame, label: str, pred: str, by: str, digits: int = 6) -> DataFrame:
    """False-positive rate fp / (fp + tn) per group; NULL without negatives."""
    c = confusion(df, label, pred, by)
    return c.select(by, (F.col("fp") + F.col("tn")).alias("negatives"),
                    F.round(F.try_divide(F.col("fp").cast("double"),
                                         (F.col("fp") + F.col("tn")).cast("double")), digits)
                    .alias("fpr"))
