"""Model inputs as long cells in one space of slots.

A step of a case is a row per value that is not 0: (case, step, input, slot, span, value).
Every input (encoded attributes, embeddings, words, case features) has its own range of
slots in a directory, so inputs of any width stand side by side in one table and no
array over a vocabulary is formed. Padding and closing steps follow from case lengths.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.functions.columns import word_tokens
from caselog.log import EventLog
from caselog.operators.lookup import Lookup


@dataclass(frozen=True)
class Directory:
    """Widths of the inputs, in order; an input's slots follow those of the one before."""

    widths: dict[str, int]

    @property
    def width(self) -> int:
        return sum(self.widths.values())

    def first(self, name: str) -> int:
        names = list(self.widths)
        return sum(self.widths[n] for n in names[:names.index(name)])

    def placed(self, name: str, cells: DataFrame) -> DataFrame:
        """The cells of one input in the common space, with its name as `input`."""
        return cells.withColumn("input", F.lit(name)).withColumn("slot", F.col("slot").cast("long") + self.first(name))

    def union(self, inputs: dict[str, DataFrame], keys: list[str]) -> DataFrame:
        """(keys, input, slot, span, value) of all inputs. Each is read once; nothing is shuffled."""
        columns = [*keys, "input", "slot", "span", "value"]
        return reduce(DataFrame.unionByName, [self.placed(n, c).select(*columns) for n, c in inputs.items()])


def embedding_cells(embedded: DataFrame, keys: list[str], words: Lookup) -> DataFrame:
    """(keys, slot, span, value): each event's score at the slot of its `key`; a score of 0 has no row."""
    rows = words.join(embedded.filter((F.col("score") != 0) & F.col("key").isNotNull()).select(*keys, "key", "score"))
    return rows.select(*keys, "slot", F.lit(1).cast("long").alias("span"), F.col("score").alias("value"))


def text_cells(events: DataFrame, keys: list[str], text: str, index) -> DataFrame:
    """(keys, slot, span, value): the id of each word at its place in the event; padding words are 0."""
    words = events.select(*keys, F.posexplode(word_tokens(text)).alias("place", "word"))
    return index.ids(words).select(
        *keys, F.col("place").cast("long").alias("slot"), F.lit(1).cast("long").alias("span"),
        F.col("word_id").cast("double").alias("value"))


def common_cases(steps: DataFrame, cases: DataFrame, *present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of steps and rows of cases, restricted to cases that all inputs have.

    `present` gives smaller tables with the same case keys as the steps, one for each separate log.
    """
    keys = [p.select("case").distinct() for p in present]
    kept = reduce(lambda a, b: a.join(b, "case", "left_semi"), keys, cases)
    return steps.join(kept.select("case"), "case", "left_semi"), kept


@dataclass(frozen=True)
class Flat:
    """`cells` (case, slot, mean, last) without the slots that are 0 in both; `cases` (case, len) of all cases."""

    cells: DataFrame
    cases: DataFrame


def flat_cells(events: DataFrame, cells: DataFrame, valid: Column) -> Flat:
    """A case's steps reduced to mean and last values over the valid ones, in long form.

    `events` holds (case, step) and the columns of `valid`; `cells` carry `valid` and
    a `step` for each value. Slots without a cell count as 0. A case without a valid
    event has no cells and `len` 0. All are sums and maxima with map-side partials, so a case of
    any length spreads over the tasks; blocks of -1 are spread over their slots per case only.
    """
    cases = events.groupBy("case").agg(
        F.count(F.when(valid, 1)).alias("len"), F.max(F.when(valid, F.col("step"))).alias("__end"))
    sums = cells.filter("valid").groupBy("case", "slot", "span").agg(
        F.sum("value").alias("__total"), F.max_by("value", "step").alias("__latest"), F.max("step").alias("__at"))
    joined = sums.join(cases, "case").select(
        "case", F.explode(F.sequence("slot", F.col("slot") + F.col("span") - 1)).alias("slot"),
        (F.col("__total") / F.col("len")).alias("mean"),
        F.when(F.col("__at") == F.col("__end"), F.col("__latest")).otherwise(F.lit(0.0)).alias("last"))
    # A slot may have cells of its own and lie in a block of -1 of other steps.
    merged = joined.groupBy("case", "slot").agg(F.sum("mean").alias("mean"), F.sum("last").alias("last"))
    return Flat(merged.filter("mean <> 0 or last <> 0"), cases.select("case", "len"))


def sparse_rows(flat: Flat, width: int, case_cells: DataFrame, cases: DataFrame, case_width: int) -> tuple[DataFrame, int]:
    """`cases` with `slots` and `values`: one sparse row per case, and the number of slots.

    Means come first, then last values, the length, the case's own features, and 1 in the
    last slot. A row has at most as many entries as there are slots, however long the case.
    """
    both = F.explode(F.array(
        F.struct(F.col("slot").alias("slot"), F.col("mean").alias("value")),
        F.struct((F.col("slot") + width).alias("slot"), F.col("last").alias("value")))).alias("cell")
    own = case_cells.select("case", F.explode(F.sequence("slot", F.col("slot") + F.col("span") - 1)).alias("slot"), "value")
    slots = 2 * width + 2 + case_width
    fixed = F.explode(F.array(
        F.struct(F.lit(2 * width).cast("long").alias("slot"), F.col("len").cast("double").alias("value")),
        F.struct(F.lit(slots - 1).cast("long").alias("slot"), F.lit(1.0).alias("value")))).alias("cell")
    cells = flat.cells.select("case", both).select("case", "cell.*").unionByName(
        own.withColumn("slot", F.col("slot") + (2 * width + 1))).unionByName(
        flat.cases.select("case", fixed).select("case", "cell.*")).filter("value <> 0")
    rows = cells.groupBy("case").agg(F.array_sort(F.collect_list(F.struct("slot", "value"))).alias("cells"))
    rows = rows.select("case", F.col("cells.slot").alias("slots"), F.col("cells.value").alias("values"))
    return cases.join(rows, "case").join(flat.cases.select("case"), "case", "left_semi"), slots
