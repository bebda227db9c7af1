"""Model inputs from end to end: placeholder, concatenation, scores, sequences, and all inputs assembled."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselog.constants import MISSING_TEXT, PAD_NUMBER
from caselog.log import EventLog
from caselog.operators.cells import Directory, common_cases, embedding_cells, text_cells
from caselog.operators.embedding import dense, duration_keyed, embedded, feature_keyed, vocabulary_list, vocabulary_lookup
from caselog.operators.encode import fit_cells
from caselog.operators.sequence import padded_log, with_steps
from caselog.operators.words import WordIndex, text_width
from caselog.plans.labels import label_table
from caselog.session import cut


def with_placeholder(df: DataFrame, name: str = "dummyf") -> DataFrame:
    """A column that is missing everywhere, for logs with a single feature."""
    return df.withColumn(name, F.lit(MISSING_TEXT))


def embedding_layer(keyed: DataFrame, log: EventLog, keys: list[str] | None = None, eos: bool = True) -> DataFrame:
    """(case, step, vec): padded sequences of the scores of a keyed log (durations or features).

    The vector has one slot per key of the vocabulary; `slotted` rows hold the same
    in one number per event where the vocabulary is too large for that.
    """
    keys = vocabulary_list(keyed) if keys is None else keys
    return padded_log(embedded(keyed, log), log, len(keys), dense(keys), eos, PAD_NUMBER, plain=keyed)


@dataclass(frozen=True)
class Inputs:
    """Columns of the inputs; what is left empty is no input."""

    categories: list[str] = field(default_factory=list)
    numbers: list[str] = field(default_factory=list)
    bins: str | None = None
    features: list[str] = field(default_factory=list)
    text: str | None = None
    case_categories: list[str] = field(default_factory=list)
    case_numbers: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Assembled:
    """Stored long cells of the inputs `event`, `duration`, `feature`, `text` and `case`, in one space of slots.

    `cells` (case, step, input, slot, span, value), case features without a step;
    `labels` (case, label, label_id), one row per case; `lengths` (case, len).
    """

    cells: DataFrame
    labels: DataFrame
    lengths: DataFrame
    directory: Directory
    classes: int


def assembled_cells(events: DataFrame, cases: DataFrame, log: EventLog, label: str, inputs: Inputs) -> Assembled:
    """All inputs of the cases that have events and a label; any number of categories, keys, words and classes.

    Events are ordered once and stored; every input is made from that table. Nothing dense is formed: what an
    event does not show is 0, and padding follows from `lengths`.
    """
    stepped = cut(with_steps(events, log), "stepped")
    keys = [log.case, "step"]
    found, widths = {}, {}
    if inputs.categories or inputs.numbers:
        encoding = fit_cells(stepped, inputs.categories, inputs.numbers, True, True)
        found["event"], widths["event"] = encoding.cells(stepped, keys), encoding.width
    keyed = {}
    if inputs.bins is not None:
        keyed["duration"] = duration_keyed(stepped, log, inputs.bins)
    if inputs.features:
        keyed["feature"] = feature_keyed(stepped, log, inputs.features)
    for name, rows in keyed.items():
        words = vocabulary_lookup(rows)
        found[name], widths[name] = embedding_cells(embedded(rows, log), keys, words), words.rows
    if inputs.text is not None:
        found["text"] = text_cells(stepped, keys, inputs.text, WordIndex(stepped, log, inputs.text))
        widths["text"] = text_width(stepped, log, inputs.text)
    known = cases.filter(F.col(label).isNotNull())
    labels, classes = label_table(known, label)
    own = known.withColumn("case", F.col(log.case))
    lengths = cut(stepped.groupBy(F.col(log.case).alias("case")).agg(F.count(F.lit(1)).alias("len")), "lengths")
    if inputs.case_categories or inputs.case_numbers:
        attributes = fit_cells(cases, inputs.case_categories, inputs.case_numbers)
        widths["case"] = attributes.width
    directory = Directory(widths)
    cells = directory.union(found, keys).withColumnRenamed(log.case, "case")
    named = own.select("case", F.col(label).alias("label")).join(labels, "label")
    steps, named = common_cases(cells, named, lengths)
    if "case" in widths:
        features = directory.union({"case": attributes.cells(own, ["case"])}, ["case"])
        features = features.join(lengths.select("case"), "case", "left_semi")
        steps = steps.unionByName(features.withColumn("step", F.lit(None).cast("long")))
    return Assembled(cut(steps, "cells"), cut(named.select("case", "label", "label_id"), "labels"), lengths, directory, classes)
