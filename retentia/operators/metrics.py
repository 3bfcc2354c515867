"""Classifier metrics over a scored frame (label 0/1, probability): D12-D17, E2.

The curve-based metrics (PR curve, ROC-AUC, average precision, tuned threshold) are
all computed from one distributed cumulative table: rows grouped by distinct score
(map-side combined), then ``running_totals`` in descending score order.  Nothing is
collected except one-row results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentia.operators.ranking import running_totals
from retentia.session import stored


def class_ratio(df: DataFrame, label: str = "y") -> DataFrame:
    """Negatives / positives (the positive class weight)."""
    neg = F.count_if(F.col(label) == 0)
    pos = F.count_if(F.col(label) == 1)
    return df.agg(
        neg.alias("n_negative"),
        pos.alias("n_positive"),
        F.try_divide(neg.cast("double"), pos.cast("double")).alias("scale_pos_weight"),
    )


def confusion(df: DataFrame, threshold: float, label: str = "y", proba: str = "y_proba") -> DataFrame:
    """One row ``tn, fp, fn, tp`` at ``proba >= threshold``."""
    pred = F.col(proba) >= F.lit(threshold)
    y = F.col(label) == 1
    return df.agg(
        F.count_if(~y & ~pred).alias("tn"),
        F.count_if(~y & pred).alias("fp"),
        F.count_if(y & ~pred).alias("fn"),
        F.count_if(y & pred).alias("tp"),
    )


def _safe_ratio(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def precision_recall_f1(df: DataFrame, threshold: float, label: str = "y", proba: str = "y_proba") -> DataFrame:
    """Precision, recall, F1 at a threshold; 0 where undefined."""
    cm = confusion(df, threshold, label, proba)
    p = _safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = _safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = _safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return cm.select(F.lit(float(threshold)).alias("threshold"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), "tn", "fp", "fn", "tp")


def score_counts(df: DataFrame, label: str = "y", proba: str = "y_proba") -> DataFrame:
    """Positives and negatives per distinct score; rows without a score or a label cannot
    be placed on the curve and are left out (of the totals too)."""
    known = df.where(F.col(proba).isNotNull() & ~F.isnan(F.col(proba)) & F.col(label).isNotNull())
    return known.groupBy(F.col(proba).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) != 1).alias("neg"),
    )


def pr_curve(df: DataFrame, label: str = "y", proba: str = "y_proba", n_buckets: int | None = None) -> DataFrame:
    """Precision and recall at every distinct score (threshold = that score, predict
    ``score >= threshold``); the terminal ``(recall 0, precision 1)`` point is not a row.

    Columns: score, pos, neg, tp, fp, precision, recall, total_pos, total_neg.
    """
    # one row per distinct score, written once: totals, splitters and sums read it again
    counts = stored(score_counts(df, label, proba), "score-counts")
    t = counts.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    cum = running_totals(counts, "score", ["pos", "neg"], descending=True, n_buckets=n_buckets)
    out = cum.withColumn("total_pos", F.lit(int(t["p"] or 0)).cast("bigint")).withColumn(
        "total_neg", F.lit(int(t["n"] or 0)).cast("bigint")
    )
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    precision = _safe_ratio(tp, tp + fp)
    recall = F.when(F.col("total_pos") > 0, tp.cast("double") / F.col("total_pos")).otherwise(F.lit(1.0))
    return out.select(
        "score",
        "pos",
        "neg",
        tp.alias("tp"),
        fp.alias("fp"),
        precision.alias("precision"),
        recall.alias("recall"),
        "total_pos",
        "total_neg",
    )


def roc_auc(curve: DataFrame) -> DataFrame:
    """ROC-AUC with ties counted half: sum over scores of neg * (tp - pos/2) / (P N)."""
    return curve.agg(
        F.try_divide(
            F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))),
            F.first("total_pos").cast("double") * F.first("total_neg").cast("double"),
        ).alias("roc_auc")
    )


def average_precision(curve: DataFrame) -> DataFrame:
    """Step-wise AP = sum over scores of (R_k - R_{k-1}) P_k = sum pos_k * P_k / P.

    Not the trapezoid area MLlib's ``areaUnderPR`` reports."""
    return curve.agg(
        F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.first("total_pos").cast("double")).alias("average_precision")
    )


def tuned_threshold(curve: DataFrame, target_precision: float) -> DataFrame:
    """Among thresholds with precision >= target the one with the largest recall,
    the lowest score on ties; when none reaches the target, the largest precision, same
    tie rule.  One row: threshold, precision, recall, met_target."""
    ok = F.col("precision") >= F.lit(target_precision)
    best_any = F.min_by(F.struct("score", "precision", "recall"), F.struct(-F.col("precision"), F.col("score")))
    agg = curve.agg(
        F.count_if(ok).alias("_n_ok"),
        F.min_by(F.struct("score", "precision", "recall"), F.when(ok, F.struct(-F.col("recall"), F.col("score")))).alias("_ok"),
        best_any.alias("_any"),
    )
    pick = F.when(F.col("_n_ok") > 0, F.col("_ok")).otherwise(F.col("_any"))
    return agg.select(
        pick["score"].alias("threshold"),
        pick["precision"].alias("precision"),
        pick["recall"].alias("recall"),
        (F.col("_n_ok") > 0).alias("met_target"),
        F.lit(float(target_precision)).alias("target_precision"),
    )
