"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.catalog.registry import query, r6
from caselog.catalog.scans import with_probability
from caselog.catalog.sql import PRED, with_
from caselog.functions.columns import argmax
from caselog.operators import evaluate as v
from caselog.sources.views import daily_history, order_predictions

MATRIX = """names AS (SELECT truth AS label FROM preds UNION SELECT pred FROM preds),
matrix AS (
  SELECT a.label AS truth, b.label AS pred,
    (SELECT count(*) FROM preds p WHERE p.truth = a.label AND p.pred = b.label) AS n
  FROM names a, names b)"""
CLASSES = MATRIX + """,
classes AS (
  SELECT label, hits, predicted, support, coalesce(hits / nullif(predicted, 0), 0) AS precision,
    coalesce(hits / nullif(support, 0), 0) AS recall
  FROM (
    SELECT label, CAST((SELECT sum(n) FROM matrix WHERE truth = label AND pred = label) AS DOUBLE) AS hits,
      CAST((SELECT sum(n) FROM matrix WHERE pred = label) AS DOUBLE) AS predicted,
      CAST((SELECT sum(n) FROM matrix WHERE truth = label) AS DOUBLE) AS support
    FROM names)),
measured AS (
  SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM classes)"""


@query("confusion_matrix", with_(PRED, MATRIX) + "SELECT truth, pred, n FROM matrix")
def confusion_matrix(spark, folder):
    return v.confusion_matrix(order_predictions(spark, folder))


@query("confusion_matrix_wide", with_(PRED) + """
SELECT truth, count(*) FILTER (pred = 'F') AS F, count(*) FILTER (pred = 'O') AS O, count(*) FILTER (pred = 'P') AS P
FROM preds GROUP BY truth""")
def confusion_matrix_wide(spark, folder):
    return v.confusion_wide(v.confusion_matrix(order_predictions(spark, folder)))


@query("classification_report", with_(PRED, CLASSES) + """
SELECT label, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f1, 4) AS f1,
  CAST(support AS BIGINT) AS support FROM measured
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM measured
UNION ALL SELECT 'macro avg', round(avg(precision), 4), round(avg(recall), 4), round(avg(f1), 4),
  CAST(sum(support) AS BIGINT) FROM measured
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 4),
  round(sum(recall * support) / sum(support), 4), round(sum(f1 * support) / sum(support), 4),
  CAST(sum(support) AS BIGINT) FROM measured""")
def classification_report(spark, folder):
    return v.classification_report(order_predictions(spark, folder))


@query("weighted_f1", with_(PRED, CLASSES) + """
SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM measured""")
def weighted_f1(spark, folder):
    return v.weighted_f1(order_predictions(spark, folder)).select(r6("weighted_f1", "weighted_f1"))


@query("accuracy", with_(PRED) + """
SELECT round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds""")
def accuracy(spark, folder):
    return v.accuracy(order_predictions(spark, folder)).select(r6("accuracy", "accuracy"))


@query("cross_entropy", with_(PRED) + """
SELECT round(avg(-ln(CASE WHEN truth = pred THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END)), 6) AS cross_entropy
FROM preds""")
def cross_entropy(spark, folder):
    rows = with_probability(order_predictions(spark, folder)).withColumn("truth_id", argmax("truth_vec"))
    return v.cross_entropy(rows, "probability", "truth_id").select(r6("cross_entropy", "cross_entropy"))


@query("best_epoch", """
WITH daily AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS metric FROM events GROUP BY 1),
numbered AS (SELECT row_number() OVER (ORDER BY day) AS epoch, metric FROM daily)
SELECT epoch, round(metric, 6) AS best FROM numbered ORDER BY metric DESC, epoch LIMIT 1""")
def best_epoch(spark, folder):
    """Days of the event table stand for epochs, their mean value for the metric."""
    return v.best_epoch(daily_history(spark, folder), "day", "metric").withColumn("best", F.round("best", 6))
