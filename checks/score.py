"""Scoring and evaluation queries."""

from pyspark.sql import functions as F

from fedtab import fixtures as fx
from fedtab.functions.common import r
from fedtab.operators import metrics as mt
from fedtab.spec import METRICS


def scored_events(spark, d):
    """Events as scored rows: label = error, logit from the value, client from the user."""
    return fx.table(spark, d, "events").select(
        "event_id", F.when(F.col("user_id") % 3 == 0, "A").when(F.col("user_id") % 3 == 1, "B")
        .otherwise("C").alias("client"),
        F.when(F.col("user_id") % 3 == 2, 0).otherwise((F.col("event_type") == "error").cast("int")).alias("label"),
        ((F.col("value") - 12.5) / 10).alias("logit"))


EVENTS = """s AS (SELECT event_id, CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS client,
    CASE WHEN user_id % 3 = 2 THEN 0 WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
    (value - 12.5) / 10 AS logit FROM events),
  p AS (SELECT *, 1 / (1 + exp(-logit)) AS prob, CASE WHEN 1 / (1 + exp(-logit)) >= 0.5 THEN 1 ELSE 0 END AS pred FROM s),
  c AS (SELECT client, count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp,
        count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn FROM p GROUP BY client),
  m AS (SELECT client, tp, fp, fn, tn, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS precision,
        coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE AS f1,
        (tp + tn) / (tp + fp + fn + tn)::DOUBLE AS accuracy,
        (tp + fp + fn + tn)::BIGINT AS n_samples, (tp + fn)::BIGINT AS n_fraud FROM c),
  g AS (SELECT client, prob, sum(label) AS np, sum(1 - label) AS nq FROM p GROUP BY client, prob),
  w AS (SELECT *, sum(nq) OVER (PARTITION BY client ORDER BY prob) - nq / 2.0::DOUBLE AS below FROM g),
  a AS (SELECT client, CASE WHEN sum(np) = 0 OR sum(nq) = 0 THEN 'nan'::DOUBLE
        ELSE sum(np * below) / (sum(np)::DOUBLE * sum(nq)) END AS auc FROM w GROUP BY client)"""


def sigmoid_probability(spark, d):
    ev = scored_events(spark, d)
    return ev.select("event_id", r(mt.sigmoid(F.col("logit") * 40)).alias("prob"),
                     r(mt.sigmoid(F.col("logit") * 40, 30), 12).alias("clipped_prob"))


def threshold_label(spark, d):
    ev = scored_events(spark, d)
    p = mt.sigmoid(F.col("logit"), 30)
    return ev.select("event_id", mt.predicted(p).alias("pred"), mt.label_text(p).alias("prediction"))


def _pred(spark, d):
    ev = scored_events(spark, d)
    return ev.withColumn("pred", mt.predicted(mt.sigmoid(F.col("logit"))))


def confusion_counts(spark, d):
    return mt.confusion(_pred(spark, d), ["client"])


def classification_metrics(spark, d):
    m = mt.rates(mt.confusion(_pred(spark, d), ["client"]))
    return m.select("client", *[r(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")],
                    "n_samples", "n_fraud")


def roc_auc(spark, d):
    ev = scored_events(spark, d).withColumn("prob", mt.sigmoid(F.col("logit")))
    return mt.roc_auc(ev, ["client"], "prob").select("client", r("auc").alias("auc"))


def macro_average(spark, d):
    per = mt.evaluate(scored_events(spark, d), ["client"])
    out = mt.macro_average(per.withColumn("run", F.lit("all")), ["run"])
    return out.select("run", *[r(c).alias(c) for c in METRICS], "n_samples", "n_fraud")


def prediction_rate(spark, d):
    return mt.prediction_rate(_pred(spark, d), ["client"]).select(
        "client", "n", r("predicted_pct").alias("predicted_pct"), r("base_pct").alias("base_pct"))


def client_round_loss(spark, d):
    return mt.client_loss(mt.evaluate(scored_events(spark, d), ["client"])).select(
        "client", r("loss").alias("loss"), "n_samples")


def label_metrics(spark, d):
    """Quality label against the toxic flag as prediction, per document language."""
    lab = fx.table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("pred"))
    docs = fx.table(spark, d, "documents").select("doc_id", "lang")
    m = mt.rates(mt.confusion(lab.join(docs, "doc_id"), ["lang"]))
    return m.select("lang", *[r(c).alias(c) for c in ("precision", "recall", "f1", "accuracy")],
                    "n_samples", "n_fraud")


QUERIES = {f.__name__: f for f in (
    sigmoid_probability, threshold_label, confusion_counts, classification_metrics, roc_auc,
    macro_average, prediction_rate, client_round_loss, label_metrics)}

SQL = {
    "sigmoid_probability": f"""WITH {EVENTS} SELECT event_id, round(1 / (1 + exp(-(logit * 40))), 6) + 0.0 AS prob,
        round(1 / (1 + exp(-greatest(least(logit * 40, 30.0), -30.0))), 12) + 0.0 AS clipped_prob FROM s""",
    "threshold_label": f"""WITH {EVENTS} SELECT event_id, pred,
        CASE pred WHEN 1 THEN 'fraud' ELSE 'legitimate' END AS prediction FROM p""",
    "confusion_counts": f"WITH {EVENTS} SELECT client, tp, fp, fn, tn FROM c",
    "classification_metrics": f"""WITH {EVENTS} SELECT client, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(f1, 6) AS f1, round(accuracy, 6) AS accuracy, n_samples, n_fraud FROM m""",
    "roc_auc": f"WITH {EVENTS} SELECT client, round(auc, 6) AS auc FROM a",
    "macro_average": f"""WITH {EVENTS} SELECT 'all' AS run, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall,
        round(avg(f1), 6) AS f1, round(coalesce(avg(auc) FILTER (NOT isnan(auc)), 'nan'::DOUBLE), 6) AS auc,
        round(avg(accuracy), 6) AS accuracy, sum(n_samples)::BIGINT AS n_samples, sum(n_fraud)::BIGINT AS n_fraud
      FROM m JOIN a USING (client)""",
    "prediction_rate": f"""WITH {EVENTS} SELECT client, count(*) AS n, round(100 * avg(pred), 6) AS predicted_pct,
        round(100 * avg(label), 6) AS base_pct FROM p GROUP BY client""",
    "client_round_loss": f"WITH {EVENTS} SELECT client, round(1 - f1, 6) AS loss, n_samples FROM m",
    "label_metrics": """WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS tp,
          count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn,
          count(*) FILTER (quality <> 1 AND toxic <> 1) AS tn FROM labels JOIN documents USING (doc_id) GROUP BY lang)
        SELECT lang, round(coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE, 6) AS precision,
          round(coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE, 6) AS recall,
          round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)::DOUBLE, 6) AS f1,
          round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy,
          (tp + fp + fn + tn)::BIGINT AS n_samples, (tp + fn)::BIGINT AS n_fraud FROM c""",
}
