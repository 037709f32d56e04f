"""Class-imbalance aware evaluation: confusion counts, rates, exact AUC, macro averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import null_safe_join, pin_small, safe_div
from ..functions.prefix import histogram_bucket, running_totals
from ..spec import METRICS


def sigmoid(logit: Column, clip: float | None = None) -> Column:
    """1 / (1 + e^-x); scoring clips the logit first."""
    x = logit.cast("double")
    if clip is not None:
        x = F.greatest(F.least(x, F.lit(float(clip))), F.lit(-float(clip)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def predicted(prob: Column, threshold: float = 0.5) -> Column:
    return (prob >= F.lit(float(threshold))).cast("int")


def label_text(prob: Column, threshold: float = 0.5) -> Column:
    return F.when(prob >= F.lit(float(threshold)), "fraud").otherwise("legitimate")


def confusion(df: DataFrame, groups: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """TP, FP, FN, TN per group in one map-side combined aggregate."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return df.groupBy(*groups).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def rates(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and accuracy; 0 where a denominator is 0."""
    def zero(a, b):
        return F.coalesce(safe_div(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return conf.withColumns({
        "precision": zero(tp, tp + fp), "recall": zero(tp, tp + fn), "f1": zero(2 * tp, 2 * tp + fp + fn),
        "accuracy": zero(tp + tn, tp + fp + fn + tn),
        "n_samples": tp + fp + fn + tn, "n_fraud": tp + fn})


def roc_auc(df: DataFrame, groups: Sequence[str], score: str, label: str = "label") -> DataFrame:
    """Exact ROC AUC with ties counted half; NaN when a class is absent.

    Pairs in different score buckets are counted on a map-side combined histogram. Only buckets
    that hold both classes need their scores in order, which for a rare class are few.
    """
    groups = list(groups)
    base = df.select(*groups, F.col(score).cast("double").alias("__s"),
                     (F.col(label) == 1).cast("bigint").alias("p"), (F.col(label) != 1).cast("bigint").alias("q"))
    base = base.withColumn("__b", histogram_bucket(F.col("__s"), 256))
    upto = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    hist = base.groupBy(*groups, "__b").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    mixed = pin_small(hist.filter("p > 0 AND q > 0").select(*groups, "__b"))
    inside = running_totals(null_safe_join(base, mixed, [*groups, "__b"], "left_semi"),
                            [*groups, "__b"], "__s", ["p", "q"])
    zero = F.lit(0).cast("bigint")
    won = (hist.withColumn("__lower", F.coalesce(F.sum("q").over(upto), F.lit(0)))
           .select(*groups, "p", "q", (F.col("p") * F.col("__lower")).cast("double").alias("won"))
           .unionByName(inside.select(*groups, zero.alias("p"), zero.alias("q"),
                                      (F.col("p") * (F.col("cum_q") - F.col("q") * F.lit(0.5))).alias("won"))))
    pairs = F.sum("p").cast("double") * F.sum("q").cast("double")
    return won.groupBy(*groups).agg(F.coalesce(safe_div(F.sum("won"), pairs), F.lit(float("nan"))).alias("auc"))


def evaluate(df: DataFrame, groups: Sequence[str], logit: str = "logit", label: str = "label",
             threshold: float = 0.5) -> DataFrame:
    """One metrics row per group from raw logits."""
    prob = sigmoid(F.col(logit))
    scored = df.withColumns({"__prob": prob, "pred": predicted(prob, threshold)})
    m = rates(confusion(scored, groups, label))
    return null_safe_join(m, roc_auc(scored, groups, "__prob", label), groups).select(
        *groups, *METRICS, "n_samples", "n_fraud")


def macro_average(metrics: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Plain mean over the clients of a group, skipping NaN; NaN when nothing is left."""
    return metrics.groupBy(*groups).agg(
        *[F.coalesce(F.avg(F.when(~F.isnan(m), F.col(m))), F.lit(float("nan"))).alias(m) for m in METRICS],
        F.sum("n_samples").cast("bigint").alias("n_samples"), F.sum("n_fraud").cast("bigint").alias("n_fraud"))


def prediction_rate(df: DataFrame, groups: Sequence[str], pred: str = "pred",
                    label: str = "label") -> DataFrame:
    """Predicted positive rate beside the base rate, in percent."""
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), (100 * F.avg(pred)).alias("predicted_pct"),
        (100 * F.avg(label)).alias("base_pct"))


def client_loss(metrics: DataFrame) -> DataFrame:
    """The loss a client reports per round: 1 - F1, with the rows it was measured on."""
    return metrics.withColumn("loss", 1 - F.col("f1"))
