"""Ordered, padded per-case sequences.

The primary form is long: one row per step, `(case, step, vec)`. A dense tensor
(every case padded to the longest) is the same rows plus padding rows; the row
form cuts a case into chunks of steps. Nothing collects a whole case into a row.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.constants import CASE_ROWS, CHUNK_STEPS, PAD_NUMBER
from caselog.functions.columns import as_column
from caselog.log import CaseProfile, EventLog, case_lengths, case_profile, with_case
from caselog.operators.ordered import LastFlagged, Ordered, Position, Previous, Total
from caselog.session import cut

PAD_BLOCK = 100_000


def ordered_cases(df: DataFrame, log: EventLog, profile: CaseProfile | None = None,
                  limit: int = CASE_ROWS) -> Ordered:
    """The log ordered inside its cases, by plain windows unless a case is too long for one task."""
    profile = profile or case_profile(df, log)
    return Ordered(with_case(df, log), [log.case], list(log.order), profile.longest, limit)


def with_steps(df: DataFrame, log: EventLog, profile: CaseProfile | None = None,
               limit: int = CASE_ROWS) -> DataFrame:
    """The log with `step`, the 0-based position of an event in its case."""
    return ordered_cases(df, log, profile, limit).add(step=Position()).result()


def float_vec(vec: Column) -> Column:
    return vec.cast("array<float>")


def steps(df: DataFrame, log: EventLog, vec: Column | str = "vec", profile: CaseProfile | None = None,
          limit: int = CASE_ROWS) -> DataFrame:
    """(case, step, vec) of every event.

    `vec` may be an expression: it is evaluated after the events are ordered, so
    that raw columns are shuffled and not the wider vectors.
    """
    return step_vectors(df, log, {"vec": vec}, profile, limit)


def step_vectors(df: DataFrame, log: EventLog, vecs: dict[str, Column | str],
                 profile: CaseProfile | None = None, limit: int = CASE_ROWS) -> DataFrame:
    """(case, step, one vector column per input) of every event, in one pass for all inputs."""
    return with_steps(df, log, profile, limit).select(
        F.col(log.case).alias("case"), "step",
        *[float_vec(as_column(vec)).alias(name) for name, vec in vecs.items()])


def constant_vec(value: float, width: int, kind: str = "float") -> Column:
    return F.array_repeat(F.lit(value).cast(kind), width)


def end_steps(lengths: DataFrame, width: int) -> DataFrame:
    """(case, step, vec): the all-zero step that closes each case."""
    return lengths.select("case", F.col("len").alias("step"), constant_vec(0.0, width).alias("vec"))


def pad_steps(lengths: DataFrame, width: int, size: int, value: float = PAD_NUMBER,
              kind: str = "float") -> DataFrame:
    """(case, step, vec): padding from each case's length up to `size`.

    Two expansions, so that no array grows with the padding.
    """
    first, last = F.col("len"), F.lit(size - 1).cast("long")
    blocks = F.explode(F.sequence(first, last, F.lit(PAD_BLOCK).cast("long")))
    inside = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + (PAD_BLOCK - 1), last)))
    return (
        lengths.filter(first < size).select("case", blocks.alias("from"))
        .select("case", inside.alias("step"))
        .select("case", "step", constant_vec(value, width, kind).alias("vec"))
    )


def with_end(step_rows: DataFrame, lengths: DataFrame, width: int) -> DataFrame:
    return step_rows.unionByName(end_steps(lengths, width))


def padded(step_rows: DataFrame, lengths: DataFrame, width: int, longest: int, eos: bool = True,
           value: float = PAD_NUMBER) -> DataFrame:
    """All steps of the dense tensor: events, the closing step if `eos`, padding."""
    size = longest + int(eos)
    filled = lengths.withColumn("len", F.col("len") + int(eos))
    rows = with_end(step_rows, lengths, width) if eos else step_rows
    return rows.unionByName(pad_steps(filled, width, size, value))


def log_lengths(df: DataFrame, log: EventLog) -> DataFrame:
    return case_lengths(df, log).withColumnRenamed(log.case, "case")


def padded_log(df: DataFrame, log: EventLog, width: int, vec: Column | str = "vec", eos: bool = True,
               value: float = PAD_NUMBER, limit: int = CASE_ROWS, plain: DataFrame | None = None) -> DataFrame:
    """(case, step, vec): the padded sequences of a log whose events carry vectors.

    `plain` may give the same events before costly columns were joined: cases are
    counted on it.
    """
    counted = df if plain is None else plain
    profile = case_profile(counted, log)
    return padded(steps(df, log, vec, profile, limit), log_lengths(counted, log), width,
                  profile.longest, eos, value)


def case_rows(step_rows: DataFrame, chunk: int = CHUNK_STEPS) -> DataFrame:
    """(case, chunk, first_step, steps): arrays of at most `chunk` steps in order.

    A case of up to `chunk` steps is one row; a longer one continues in the next.
    """
    return (
        step_rows.withColumn("chunk", F.floor(F.col("step") / chunk).cast("long"))
        .groupBy("case", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("step", "vec"))).alias("items"))
        .select("case", "chunk", F.get("items", F.lit(0))["step"].alias("first_step"),
                F.col("items.vec").alias("steps"))
    )


# -- simultaneous events ------------------------------------------------------------------


def largest_cooccurrence(df: DataFrame, log: EventLog) -> DataFrame:
    """One row: the largest number of events with the same case and start time."""
    return (
        with_case(df, log).filter(F.col(log.start).isNotNull())
        .groupBy(log.case, log.start).agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n").alias("max_cooccur"))
    )


def stacked_events(df: DataFrame, log: EventLog, profile: CaseProfile | None = None,
                   limit: int = CASE_ROWS) -> DataFrame:
    """The log with `step` and `place`: consecutive events that start together share
    a step, in which they are numbered from 0."""
    run = ordered_cases(df, log, profile, limit).add(__earlier=Previous(log.start))
    together = F.coalesce(F.col("__earlier") == F.col(log.start), F.lit(False))
    run.with_column("__new", ~together)
    run.add(__steps=Total(F.col("__new").cast("long")), __at_new=LastFlagged("__new"), __at_row=Position())
    return (
        run.result()
        .withColumn("step", F.col("__steps") - 1)
        .withColumn("place", F.col("__at_row") + 1 - F.col("__at_new"))
        .drop("__earlier", "__new", "__steps", "__at_new", "__at_row")
    )


def stacked_steps(df: DataFrame, log: EventLog, width: int, most: int, vec: Column | str = "vec",
                  profile: CaseProfile | None = None, limit: int = CASE_ROWS) -> DataFrame:
    """(case, step, vec): vectors of simultaneous events side by side, -1 up to `most` events.

    Every step is as wide as the largest one, so `most` is checked; beyond it the
    rows of `stacked_events` are the result.
    """
    if most > CHUNK_STEPS:
        raise ValueError(f"{most} simultaneous events: use the rows of `stacked_events`")
    return _side_by_side(stacked_events(df, log, profile, limit), log, width, most, vec)


def stacked_cells(df: DataFrame, log: EventLog, cells: DataFrame, width: int, key: str,
                  profile: CaseProfile | None = None, limit: int = CASE_ROWS) -> DataFrame:
    """(case, step, slot, span, value): simultaneous events side by side, for any number of them.

    `cells` has (`key`, slot, span, value) of the events; the slots of the event at
    place k of its step begin at k * `width`. Missing places are padding by rule.
    """
    events = stacked_events(df, log, profile, limit).select(F.col(log.case).alias("case"), key, "step", "place")
    return events.join(cells, key).select(
        "case", "step", (F.col("place") * width + F.col("slot")).alias("slot"), "span", "value")


@dataclass(frozen=True)
class Stacked:
    """Stored `events` with step and place, `steps` (case, step, places), and `lengths` (case, len) in steps."""

    events: DataFrame
    steps: DataFrame
    lengths: DataFrame
    most: int
    longest: int


def stacked_log(df: DataFrame, log: EventLog, profile: CaseProfile | None = None, limit: int = CASE_ROWS,
                columns: list[str] | None = None) -> Stacked:
    """The log ordered once, simultaneous events in one step, with the sizes that padding follows from.

    Of the events all columns are stored, or the case, step, place and those of `columns`.
    """
    placed = stacked_events(df, log, profile, limit)
    if columns is not None:
        placed = placed.select(*dict.fromkeys([log.case, "step", "place", *columns]))
    events = cut(placed, "stacked")
    steps = cut(events.groupBy(F.col(log.case).alias("case"), "step").agg(F.count(F.lit(1)).alias("places")), "steps")
    # Events of a case lie together, so they are reduced before they meet; its steps are numbered without gaps.
    lengths = cut(events.groupBy(F.col(log.case).alias("case")).agg((F.max("step") + 1).alias("len")), "lengths")
    most = steps.agg(F.max("places")).first()[0] or 1
    return Stacked(events, steps, lengths, most, lengths.agg(F.max("len")).first()[0] or 0)


def padded_stacked_cells(stacked: Stacked, log: EventLog, encoding, eos: bool = True, mark: str | None = None) -> DataFrame:
    """(case, step, slot, span, value): the padded stacked sequences in long form, for any number of events a step.

    `encoding` makes the cells of the events (`fit_cells`). Missing places of a step are one
    span of -1, a padding step is a single span, and the closing step, all 0, is a
    span of 0. Slots without a row are 0. No array as wide as a step is formed.
    `mark` names one more column: true in padding and closing steps, of which this row is the
    whole, false in steps of events. A filter on it leaves out the other kind's plan.
    """
    width, value = encoding.width, F.lit(PAD_NUMBER)
    keys = [log.case, "step", "place"]
    cells = encoding.cells(stacked.events, keys).select(
        F.col(log.case).alias("case"), "step", (F.col("place") * width + F.col("slot")).alias("slot"), "span", "value")
    free = stacked.steps.filter(F.col("places") < stacked.most).select(
        "case", "step", (F.col("places") * width).cast("long").alias("slot"),
        ((F.lit(stacked.most) - F.col("places")) * width).cast("long").alias("span"), value.alias("value"))
    whole = F.lit(stacked.most * width).cast("long").alias("span")
    filled = stacked.lengths.withColumn("len", F.col("len") + int(eos))
    blank = pad_steps(filled, 0, stacked.longest + int(eos)).select(
        "case", "step", F.lit(0).cast("long").alias("slot"), whole, value.alias("value"))
    if eos:
        blank = blank.unionByName(stacked.lengths.select(
            "case", F.col("len").alias("step"), F.lit(0).cast("long").alias("slot"), whole, F.lit(0.0).alias("value")))
    events = cells.unionByName(free)
    if mark is not None:
        events, blank = events.withColumn(mark, F.lit(False)), blank.withColumn(mark, F.lit(True))
    return events.unionByName(blank)


def _side_by_side(events: DataFrame, log: EventLog, width: int, most: int, vec: Column | str) -> DataFrame:
    joined = F.flatten(F.transform("items", lambda i: i["vec"]))
    missing = F.array_repeat(F.lit(PAD_NUMBER).cast("float"), F.lit(width) * (F.lit(most) - F.size("items")))
    return (
        events.groupBy(F.col(log.case).alias("case"), "step")
        .agg(F.array_sort(F.collect_list(F.struct("place", float_vec(as_column(vec)).alias("vec")))).alias("items"))
        .select("case", "step", F.concat(joined, missing).alias("vec"))
    )


def padded_stacked_log(df: DataFrame, log: EventLog, width: int, vec: Column | str = "vec", eos: bool = True,
                       limit: int = CASE_ROWS) -> DataFrame:
    """(case, step, vec): padded sequences with simultaneous events in one step."""
    most = largest_cooccurrence(df, log).first()["max_cooccur"] or 1
    profile = case_profile(df, log)
    if most > CHUNK_STEPS:
        raise ValueError(f"{most} simultaneous events: use `stacked_cells`")
    # Ordered once: the steps and their number come from the same kept rows.
    events = cut(stacked_events(df, log, profile, limit), "stacked")
    rows = _side_by_side(events, log, width, most, vec)
    lengths = cut(events.groupBy(F.col(log.case).alias("case")).agg((F.max("step") + 1).alias("len")), "lengths")
    longest = lengths.agg(F.max("len").alias("n")).first()["n"] or 0
    return padded(rows, lengths, width * most, longest, eos)


# -- shape and validity -----------------------------------------------------------------------


@dataclass(frozen=True)
class Input:
    """A padded input by its case lengths (case, len): padding is known by rule and not formed."""

    lengths: DataFrame
    width: int
    eos: bool = False


def _case_mark() -> Column:
    """A hash of a case and its length; equal sums over equal sets of cases."""
    return F.xxhash64(F.col("case").cast("string"), F.col("len").cast("long"))


def input_shapes(inputs: dict[str, Input], classes: int | None = None, case_features: int | None = None) -> DataFrame:
    """One row per input: (input, cases, steps, width, regular, classes, case_features).

    A padded input has as many steps as its longest case, and one more with a
    closing step. `regular` says that all inputs agree in cases, in the length of each
    case, and in steps: a fingerprint over (case, length) of every input, mergeable like
    a sum, is compared, so inputs may come from different tables. `input_agreement` tells where they differ.
    """
    rows = None
    for name, given in inputs.items():
        own = given.lengths.agg(
            F.count(F.lit(1)).alias("cases"), (F.coalesce(F.max("len"), F.lit(0)) + int(given.eos)).cast("long").alias("steps"),
            F.coalesce(F.sum(_case_mark().cast("decimal(38,0)")), F.lit(0)).alias("mark"),
            F.coalesce(F.bit_xor(_case_mark()), F.lit(0)).alias("cross"),
        ).select(F.lit(name).alias("input"), "cases", "steps", F.lit(given.width).cast("long").alias("width"), "mark", "cross")
        rows = own if rows is None else rows.unionAll(own)
    everything = Window.partitionBy()
    regular = F.lit(True)
    for fact in ("cases", "steps", "mark", "cross"):
        regular = regular & (F.min(fact).over(everything) == F.max(fact).over(everything))
    return rows.select("*", regular.alias("regular"), F.lit(classes).cast("long").alias("classes"),
                       F.lit(case_features).cast("long").alias("case_features")).drop("mark", "cross")


def input_agreement(inputs: dict[str, Input]) -> DataFrame:
    """One row per input: (input, cases, missing, shorter).

    `missing` counts the cases that other inputs have and this one has not, `shorter`
    those that are longer in another input. All inputs meet by case once.
    """
    names = list(inputs)
    rows = None
    for k, name in enumerate(names):
        own = inputs[name].lengths.select("case", F.lit(k).alias("k"), F.col("len").cast("long").alias("len"))
        rows = own if rows is None else rows.unionByName(own)
    per_case = rows.groupBy("case").agg(
        F.max("len").alias("most"), *[F.max(F.when(F.col("k") == k, F.col("len"))).alias(f"len{k}") for k in range(len(names))])
    facts = per_case.agg(*[
        F.struct(F.count(f"len{k}").alias("cases"), F.count(F.when(F.col(f"len{k}").isNull(), 1)).alias("missing"),
                 F.count(F.when(F.col(f"len{k}") < F.col("most"), 1)).alias("shorter")).alias(f"f{k}") for k in range(len(names))])
    return facts.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("input"), *[F.col(f"f{k}.{c}").alias(c) for c in ("cases", "missing", "shorter")])
        for k, name in enumerate(names)])).alias("r")).select("r.*")


def real_step_mask(df: DataFrame, log: EventLog, known: dict[str, Column], profile: CaseProfile | None = None,
                   limit: int = CASE_ROWS) -> DataFrame:
    """(case, step, valid) of the real steps; valid if any input of the event is known.

    `known` has a condition on the raw columns for each input of one log. A padding
    step is invalid by rule and has no row.
    """
    valid = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in known.values()])
    kept = with_case(df, log).select(log.case, *[c for c in log.order if c != log.case], valid.alias("valid"))
    return with_steps(kept, log, profile, limit).select(F.col(log.case).alias("case"), "step", "valid")


def tensor_shape(step_rows: DataFrame) -> DataFrame:
    """One row (cases, steps, width) of padded step rows, and whether all agree."""
    per_case = step_rows.groupBy("case").agg(
        F.count(F.lit(1)).alias("len"), F.min(F.size("vec")).alias("low"), F.max(F.size("vec")).alias("high"))
    return per_case.agg(
        F.count(F.lit(1)).alias("cases"),
        F.max("len").alias("steps"), F.max("high").alias("width"),
        ((F.min("len") == F.max("len")) & (F.min("low") == F.max("high"))).alias("regular"),
    )


def is_valid(vec: Column | str, pad: float = PAD_NUMBER) -> Column:
    """A step is valid if any of its values differs from the padding value."""
    value = F.lit(pad).cast("float")
    return F.coalesce((F.array_max(vec) != value) | (F.array_min(vec) != value), F.lit(False))


def step_mask(inputs: dict[str, DataFrame], pads: dict[str, float] | None = None) -> DataFrame:
    """(case, step, valid): valid if any input has a valid step there."""
    pads = pads or {}
    flags = None
    for name, rows in inputs.items():
        here = rows.select("case", "step", is_valid("vec", pads.get(name, PAD_NUMBER)).alias("valid"))
        flags = here if flags is None else flags.unionByName(here)
    return flags.groupBy("case", "step").agg(F.max("valid").alias("valid"))
