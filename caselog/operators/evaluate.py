"""Evaluation of outcome predictions.

Predictions are counted once into (truth, pred) pairs; all reports read those
counts, which have at most labels x labels rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.functions.columns import as_column

# Fixed value: probabilities are kept this far from 0 and 1.
CLIP = 1e-7


def pair_counts(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return predictions.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """(truth, pred, n) for all labels that occur on either side, zero cells included.

    A missing label is a label like any other (null), so every prediction is in a cell.
    """
    counts = pair_counts(predictions, truth, pred)
    # Structs keep a null label in the list, which holds every label once.
    side = F.explode(F.array(F.struct(F.col("truth").alias("label")), F.struct(F.col("pred").alias("label"))))
    labels = counts.select(side.alias("side")).distinct().agg(F.collect_list("side").alias("labels"))
    cells = labels.select(F.explode("labels").alias("a"), "labels").select(
        F.col("a.label").alias("truth"), F.explode("labels").alias("b")).select("truth", F.col("b.label").alias("pred"))
    match = cells["truth"].eqNullSafe(counts["truth"]) & cells["pred"].eqNullSafe(counts["pred"])
    return cells.join(counts, match, "left").select(
        cells["truth"], cells["pred"], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label_list(matrix: DataFrame) -> list:
    """The labels of a confusion matrix in order, a missing one last."""
    found = [r["truth"] for r in matrix.select("truth").distinct().collect()]
    return sorted(x for x in found if x is not None) + [None] * (None in found)


def confusion_wide(matrix: DataFrame, labels: list | None = None, missing: str = "null") -> DataFrame:
    """One row per truth, one column per predicted label (by default all that occur)."""
    labels = label_list(matrix) if labels is None else labels
    named = matrix.withColumn("pred", F.coalesce(F.col("pred").cast("string"), F.lit(missing)))
    return named.groupBy("truth").pivot("pred", [missing if x is None else str(x) for x in labels]).agg(F.sum("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def class_scores(matrix: DataFrame) -> DataFrame:
    """(label, hits, predicted, support, precision, recall, f1); 0 on division by zero."""
    sides = matrix.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("truth").eqNullSafe(F.col("pred")), F.col("n")).otherwise(0).alias("hits")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hits")),
    )).alias("side")).select("side.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "support")])
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    return sums.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def classification_report(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Rows per label, then `accuracy`, `macro avg` and `weighted avg`, to 4 digits."""
    scores = class_scores(confusion_matrix(predictions, truth, pred))
    measures = ["precision", "recall", "f1"]
    rows = F.sum("support")
    per_label = scores.select(F.col("label").cast("string").alias("label"), *measures, "support")
    summary = scores.agg(
        (F.sum("hits") / rows).alias("accuracy"), rows.alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / rows).alias(f"weighted_{m}") for m in measures],
    )
    missing = F.lit(None).cast("double")

    def line(name: str, values: list[Column]) -> Column:
        return F.struct(F.lit(name).alias("label"), *[v.alias(m) for v, m in zip(values, measures)], F.col("support"))

    totals = summary.select(F.explode(F.array(
        line("accuracy", [missing, missing, F.col("accuracy")]),
        line("macro avg", [F.col(f"macro_{m}") for m in measures]),
        line("weighted avg", [F.col(f"weighted_{m}") for m in measures]),
    )).alias("r")).select("r.*")
    return per_label.unionByName(totals).select(
        "label", *[F.round(m, 4).alias(m) for m in measures], F.col("support").cast("long").alias("support"))


def weighted_f1(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    scores = class_scores(confusion_matrix(predictions, truth, pred))
    return scores.agg((F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def accuracy(predictions: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return predictions.agg(F.avg(F.col(truth).eqNullSafe(F.col(pred)).cast("double")).alias("accuracy"))


def cross_entropy(predictions: DataFrame, probability: str, truth_id: str) -> DataFrame:
    """Mean categorical cross-entropy of probability rows, scaled to sum 1 and clipped."""
    p = as_column(probability)
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    share = F.get(p, F.col(truth_id)) / total
    clipped = F.greatest(F.least(share, F.lit(1.0 - CLIP)), F.lit(CLIP))
    return predictions.agg(F.avg(-F.log(clipped)).alias("cross_entropy"))


def best_epoch(history: DataFrame, order: str, metric: str) -> DataFrame:
    """One row (epoch, best): number, from 1, of the first epoch with the largest metric.

    `order` is unique; the number is the count of epochs up to the best one, so
    nothing is sorted.
    """
    first = history.agg(F.min_by(order, F.struct(-F.col(metric), F.col(order)))).scalar()
    upto = F.when(F.col(order) <= first, 1)
    return history.agg(F.count(upto).alias("epoch"), F.max(metric).alias("best"))
