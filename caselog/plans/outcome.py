"""Outcome prediction from end to end: encode, embed, assemble, split, train, evaluate.

Stands in for recurrent networks: a case's sequence is reduced to one sparse row, on
which a softmax model is fitted. It is another model on the same inputs, so its scores are
not those of a network.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.log import EventLog
from caselog.operators import linear
from caselog.operators.cells import Directory, embedding_cells, flat_cells, sparse_rows
from caselog.operators.dataset import fit_stratified
from caselog.operators.embedding import vocabulary_lookup
from caselog.operators.encode import fit_cells
from caselog.operators.evaluate import classification_report, confusion_matrix
from caselog.operators.sequence import with_steps
from caselog.plans.labels import label_table
from caselog.session import cut

ROUNDS = 20


@dataclass(frozen=True)
class Prepared:
    """`cases` (case, label, label_id, slots, values, split), stored, one row per case with events and a label.

    `labels` (label, label_id) is a stored table, for any number of classes.
    """

    cases: DataFrame
    labels: DataFrame
    slots: int
    classes: int

    @property
    def train(self) -> DataFrame:
        return self.cases.filter(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.cases.filter(F.col("split") == "test")

    def tuning(self, share: float = 0.2, seed: int = 43) -> tuple[DataFrame, DataFrame]:
        """Parts of the training cases to fit and to choose on; the test cases stay out of the choice."""
        split = fit_stratified(self.train, "case", "label", share, seed).apply(self.train, "part")
        part = cut(split, "tuning")
        return part.filter(F.col("part") == "train"), part.filter(F.col("part") == "test")


def prepare(events: DataFrame, cases: DataFrame, log: EventLog, label: str,
            event_categories: list[str], event_numbers: list[str],
            case_categories: list[str], case_numbers: list[str],
            embedding: bool = False, test_share: float = 0.2, seed: int = 42) -> Prepared:
    """Encode events and cases in long form and join them by case, for any number of categories, keys and classes.

    With `embedding`, the events carry the `key` and `score` of an embedding, which join the inputs.
    """
    columns = dict.fromkeys([*event_categories, *event_numbers, *(["key", "score"] if embedding else [])])
    stepped = cut(with_steps(events, log).select(F.col(log.case).alias("case"), "step", *columns), "stepped")
    encoding = fit_cells(stepped, event_categories, event_numbers, True, True)
    # An embedded event has no -1 among its scores.
    valid = F.lit(True) if embedding else encoding.is_valid()
    keys = ["case", "step", "valid"]
    rows = stepped.withColumn("valid", valid)
    inputs, widths = {"event": encoding.cells(rows, keys)}, {"event": encoding.width}
    if embedding:
        words = vocabulary_lookup(stepped)
        inputs["embedding"] = embedding_cells(rows, keys, words)
        widths["embedding"] = words.rows
    directory = Directory(widths)
    flat = flat_cells(stepped, directory.union(inputs, keys), valid)
    known = cases.filter(F.col(label).isNotNull())
    labels, classes = label_table(known, label)
    attributes = fit_cells(cases, case_categories, case_numbers)
    keyed = known.withColumn("case", F.col(log.case))
    table = keyed.select("case", F.col(label).alias("label")).join(labels, "label")
    joined, slots = sparse_rows(flat, directory.width, attributes.cells(keyed, ["case"]), table, attributes.width)
    stored = cut(joined, "rows")
    split = fit_stratified(stored, "case", "label", test_share, seed).apply(stored)
    return Prepared(cut(split, "split"), labels, slots, classes)


def predictions(scored_cases: DataFrame, labels: DataFrame) -> DataFrame:
    """(case, truth, pred, truth_id, probability) with label names."""
    names = labels.select(F.col("label").alias("pred_label"), F.col("label_id").alias("pred"))
    return scored_cases.join(names, "pred").select(
        "case", F.col("label").alias("truth"), F.col("pred_label").alias("pred"), F.col("label_id").alias("truth_id"), "probability")


@dataclass(frozen=True)
class Evaluated:
    model: linear.Model
    predictions: DataFrame
    confusion: DataFrame
    report: DataFrame


def tune(prepared: Prepared, strengths: tuple[float, ...] = (0.001, 0.01, 0.1), mixings: tuple[float, ...] = (0.0, 0.5),
         rounds: int = ROUNDS) -> DataFrame:
    """All trials of a grid, fitted side by side on a part of the training cases and scored on the rest of them."""
    fitted, held = prepared.tuning()
    model = linear.fit(fitted, prepared.slots, prepared.classes, linear.grid(strengths, mixings), rounds)
    return linear.trials(held, model)


def best_setting(trials: DataFrame, metric: str = "weighted_f1") -> linear.Setting:
    """The setting of the first trial with the largest metric."""
    row = trials.orderBy(F.desc(metric), "trial").select("strength", "mixing").first()
    return linear.Setting(row["strength"], row["mixing"])


def train_and_evaluate(prepared: Prepared, tuned: bool = False, setting: linear.Setting = linear.Setting(),
                       rounds: int = ROUNDS, **options) -> Evaluated:
    if tuned:
        setting = best_setting(tune(prepared, rounds=rounds, **options))
    model = linear.fit(prepared.train, prepared.slots, prepared.classes, [setting], rounds)
    result = predictions(linear.probabilities(prepared.test, model), prepared.labels)
    return Evaluated(model, result, confusion_matrix(result), classification_report(result))
