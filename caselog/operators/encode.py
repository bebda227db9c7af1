"""Encoding of categorical and numeric attributes.

`fit_*` reads small facts of the columns (categories, ranges, medians) and
returns an object whose expressions are evaluated row by row, so encoding an event
log needs no shuffle. Columns with more categories than a dense block should hold
are encoded sparsely, by joining a category table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from caselog.constants import BROADCAST_BYTES, DENSE_WIDTH, MISSING_NUMBER, MISSING_TEXT, SMALL_ROWS
from caselog.functions.columns import missing_to_null, one_slot
from caselog.operators.histogram import Histogram
from caselog.operators.lookup import Lookup, row_bytes
from caselog.operators.ordered import Ordered, Position
from caselog.session import cut

MASKED = float(MISSING_NUMBER)


def empty_block() -> Column:
    return F.array().cast("array<double>")


# -- categories -------------------------------------------------------------------------


@dataclass(frozen=True)
class OneHot:
    """Sorted categories per column; a null, where one occurs, comes last."""

    categories: dict[str, list]
    types: dict[str, str]
    missing: str | None = None

    @property
    def width(self) -> int:
        return sum(len(c) for c in self.categories.values())

    def block(self, column: str) -> Column:
        """0/1 per category; all -1 where the column holds the missing marker."""
        value, width = F.col(column), len(self.categories[column])
        slots = one_slot(self.place(column), width, F.lit(1.0))
        if self.missing is None or self.missing not in self.categories[column]:
            return slots
        masked = F.array_repeat(F.lit(MASKED), width)
        return F.when(value.cast("string").eqNullSafe(F.lit(self.missing)), masked).otherwise(slots)

    def place(self, column: str) -> Column:
        """1-based place of the row's category, 0 or null for an unknown one."""
        values = self.categories[column]
        known = [v for v in values if v is not None]
        place = F.array_position(F.lit(known).cast(f"array<{self.types[column]}>"), F.col(column)).cast("int")
        if len(known) < len(values):
            place = F.when(F.col(column).isNull(), F.lit(len(values))).otherwise(place)
        return place

    def vector(self) -> Column:
        """The blocks of all columns, one after the other."""
        return F.concat(*[self.block(c) for c in self.categories]) if self.categories else empty_block()


def fit_onehot(df: DataFrame, columns: list[str], missing: str | None = None,
               limit: int = DENSE_WIDTH) -> OneHot:
    """Categories of each column; fails beyond `limit`, where `category_slots` applies.

    Each column is read on its own, so a columnar source reads every column once.
    """
    categories = {}
    for c in columns:
        found = [r[0] for r in df.select(c).distinct().limit(limit + 1).collect()]
        if len(found) > limit:
            raise ValueError(f"{c} has more than {limit} categories: use `category_slots`")
        categories[c] = sorted(v for v in found if v is not None) + [None] * (None in found)
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    return OneHot(categories, types, missing)


def category_slots(df: DataFrame, columns: list[str], limit: int = SMALL_ROWS) -> DataFrame:
    """(name, value, slot): slots of all columns' categories, for any number of them.

    Values are shown as text but ordered as what they are, numbers by size; a null
    takes the last slot of its column.
    """
    types = [df.schema[c].dataType for c in columns]
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(i).alias("block"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value"),
            *[(F.col(c) if i == j else F.lit(None)).cast(t).alias(f"k{j}") for j, t in enumerate(types)])
        for i, c in enumerate(columns)
    ]))
    keys = [f"k{j}" for j in range(len(columns))]
    found = cut(df.select(cells.alias("cell")).select("cell.*").distinct())
    order = ["block", *[F.col(k).asc_nulls_last() for k in keys]]
    return Ordered(found, [], order, found.count(), limit).add(slot=Position()).result().drop("block", *keys)


def onehot_cells(df: DataFrame, keys: list[str], columns: list[str], slots: DataFrame,
                 missing: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(keys, name, slot, value) of the category each row has; -1 stands for a masked block."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    rows = df.select(*keys, cells.alias("cell")).select(*keys, "cell.*")
    small = slots.agg(F.coalesce(F.sum(row_bytes(["name", "value"])), F.lit(0))).first()[0] <= broadcast_bytes
    right = slots.select(F.col("name").alias("__name"), F.col("value").alias("__value"), "slot")
    match = (F.col("name") == F.col("__name")) & F.col("value").eqNullSafe(F.col("__value"))
    joined = rows.join(F.broadcast(right) if small else right, match)
    masked = F.col("value").eqNullSafe(F.lit(missing)) if missing is not None else F.lit(False)
    return joined.select(
        *keys, "name", "slot", F.when(masked, F.lit(MASKED)).otherwise(F.lit(1.0)).alias("cell"))


# -- numbers ------------------------------------------------------------------------------


@dataclass(frozen=True)
class MinMax:
    """Range of each column, with what takes the place of a missing value.

    `fill` holds the medians when missing values are imputed; without it a missing
    value stays -1.
    """

    low: dict[str, float | None]
    high: dict[str, float | None]
    fill: dict[str, float | None] | None = None

    @property
    def width(self) -> int:
        return len(self.low)

    def scaled(self, column: str) -> Column:
        low, high = self.low[column], self.high[column]
        if low is None:
            return F.lit(None).cast("double") if self.fill is not None else F.lit(MASKED)
        value = missing_to_null(column)
        if self.fill is not None:
            value = F.coalesce(value, F.lit(self.fill[column]))
        span = high - low
        result = (value - F.lit(low)) / F.lit(span if span > 0 else 1.0)
        return result if self.fill is not None else F.coalesce(result, F.lit(MASKED))

    def vector(self) -> Column:
        return F.array(*[self.scaled(c) for c in self.low]).cast("array<double>") if self.low else empty_block()


def fit_minmax(df: DataFrame, columns: list[str]) -> MinMax:
    """Ranges of the valid values, one pass for all columns."""
    if not columns:
        return MinMax({}, {})
    facts = [f(missing_to_null(c)).alias(f"{n}{i}")
             for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]
    row = df.agg(*facts).first()
    return MinMax({c: row[f"low{i}"] for i, c in enumerate(columns)},
                  {c: row[f"high{i}"] for i, c in enumerate(columns)})


def fit_median(df: DataFrame, columns: list[str], limit: int = SMALL_ROWS) -> MinMax:
    """Ranges and exact medians, from one count of the values of all columns."""
    if not columns:
        return MinMax({}, {}, {})
    hist = Histogram(df, {c: missing_to_null(c) for c in columns}, limit)
    medians = hist.quantiles({c: [0.5] for c in columns})
    s = hist.summaries
    return MinMax({c: s[c].lowest for c in columns}, {c: s[c].highest for c in columns},
                  {c: (medians.get(c) or [None])[0] for c in columns})


# -- both -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Vectors:
    """One-hot blocks followed by scaled numbers."""

    onehot: OneHot
    numbers: MinMax

    @property
    def width(self) -> int:
        return self.onehot.width + self.numbers.width

    def vector(self) -> Column:
        return F.concat(self.onehot.vector(), self.numbers.vector())

    def apply(self, df: DataFrame, name: str = "vec") -> DataFrame:
        return df.withColumn(name, self.vector())

    def is_valid(self) -> Column:
        """Whether the vector holds anything but -1, from the raw columns.

        Only masked blocks and missing numbers give -1: any other one makes the
        vector valid.
        """
        known = F.lit(False)
        for c, values in self.onehot.categories.items():
            masked = self.onehot.missing is not None and self.onehot.missing in values
            marker = F.col(c).cast("string").eqNullSafe(F.lit(self.onehot.missing))
            known = known | (~marker if masked else F.lit(True))
        for c in self.numbers.low:
            known = known | (missing_to_null(c).isNotNull() if self.numbers.fill is None else F.lit(True))
        return known


def fit_vectors(df: DataFrame, categories: list[str], numbers: list[str],
                mask_categories: bool = False, mask_numbers: bool = False,
                missing: str = MISSING_TEXT) -> Vectors:
    """Either list may be empty; masking keeps missing values visible as -1."""
    onehot = fit_onehot(df, categories, missing if mask_categories else None)
    scale = fit_minmax(df, numbers) if mask_numbers else fit_median(df, numbers)
    return Vectors(onehot, scale)


@dataclass(frozen=True)
class CellFit:
    """What the long form of the vectors needs, fitted in one pass over the rows.

    `slots` is a lookup of (block, value) with slot, and first slot and width of the
    column's block; None without categories.
    """

    categories: list[str]
    missing: str | None
    slots: Lookup | None
    first_number: int
    scale: MinMax

    @property
    def width(self) -> int:
        return self.first_number + self.scale.width

    def cells(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, slot, span, value): `value` fills `span` slots from `slot` on.

        One slot, or a whole block of -1 where a masked category is missing. Slots
        without a row are 0. An unknown category has no row.
        """
        parts = []
        if self.slots is not None:
            found = F.explode(F.array(*[
                F.struct(F.lit(i).alias("block"), F.col(c).cast("string").alias("value"))
                for i, c in enumerate(self.categories)]))
            hits = self.slots.join(df.select(*keys, found.alias("cell")).select(*keys, "cell.block", "cell.value"))
            masked = F.lit(False) if self.missing is None else F.col("value").eqNullSafe(F.lit(self.missing))
            parts.append(hits.select(
                *keys, F.when(masked, F.col("first")).otherwise(F.col("slot")).alias("slot"),
                F.when(masked, F.col("width")).otherwise(F.lit(1)).cast("long").alias("span"),
                F.when(masked, F.lit(MASKED)).otherwise(F.lit(1.0)).alias("value")))
        if self.scale.low:
            scaled = F.explode(F.array(*[
                F.struct(F.lit(self.first_number + i).cast("long").alias("slot"), F.lit(1).cast("long").alias("span"),
                         self.scale.scaled(c).cast("double").alias("value")) for i, c in enumerate(self.scale.low)]))
            parts.append(df.select(*keys, scaled.alias("cell")).select(*keys, "cell.*"))
        return reduce(DataFrame.unionByName, parts)

    def is_valid(self) -> Column:
        """Whether a row has any value but -1, from the raw columns."""
        known = F.lit(False)
        for c in self.categories:
            known = known | (F.lit(True) if self.missing is None else ~F.col(c).cast("string").eqNullSafe(F.lit(self.missing)))
        for c in self.scale.low:
            known = known | (F.lit(True) if self.scale.fill is not None else missing_to_null(c).isNotNull())
        return known


def fit_cells(df: DataFrame, categories: list[str], numbers: list[str], mask_categories: bool = False,
              mask_numbers: bool = False, missing: str = MISSING_TEXT, limit: int = SMALL_ROWS) -> CellFit:
    """Categories, ranges and, unless numbers are masked, value counts, all from one aggregate.

    Categories are numbered as `category_slots` does. At least one column is needed.
    """
    nothing = F.lit(None)
    parts = [F.struct(
        F.lit(i).alias("block"), F.lit(c).alias("name"), F.col(c).cast("string").alias("value"),
        (F.col(c) if isinstance(df.schema[c].dataType, NumericType) else nothing).cast("double").alias("number"),
        nothing.cast("double").alias("amount")) for i, c in enumerate(categories)]
    parts += [F.struct(
        F.lit(-1).alias("block"), F.lit(c).alias("name"), nothing.cast("string").alias("value"),
        (nothing.cast("double") if mask_numbers else missing_to_null(c)).alias("number"),
        missing_to_null(c).alias("amount")) for c in numbers]
    facts = cut(df.select(F.explode(F.array(*parts)).alias("cell")).select("cell.*").groupBy(
        "block", "name", "value", "number").agg(
        F.count(F.lit(1)).alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high")), "facts")
    # One row per column.
    sizes = {r["name"] if r["block"] < 0 else r["block"]: r for r in facts.groupBy("block", "name").agg(
        F.count(F.lit(1)).alias("width"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum(row_bytes(["value"])).alias("size")).collect()}
    widths = [sizes[i]["width"] if i in sizes else 0 for i in range(len(categories))]
    first = [sum(widths[:i]) for i in range(len(categories) + 1)]
    fill = None
    if not mask_numbers and numbers:
        values = facts.filter("block < 0").select("name", F.col("number").alias("value"), "n")
        medians = Histogram.counted(values, numbers, limit).quantiles({c: [0.5] for c in numbers})
        fill = {c: (medians.get(c) or [None])[0] for c in numbers}
    if not mask_numbers and not numbers:
        fill = {}
    low, high = ({c: sizes[c][k] if c in sizes else None for c in numbers} for k in ("low", "high"))
    slots = None
    if categories:
        known = facts.filter("block >= 0").select("block", "value", "number", "n")
        order = [F.col("value").isNull(), "number", "value"]
        placed = Ordered(known, ["block"], order, max(widths), limit).add(place=Position()).result()
        begin, width = (F.get(F.lit(x).cast("array<long>"), F.col("block")) for x in (first[:-1], widths))
        table = placed.select("block", "value", "n", (begin + F.col("place")).alias("slot"), begin.alias("first"), width.alias("width"))
        slots = Lookup(table, ["block", "value"], first[-1], sum(sizes[i]["size"] for i in sizes if isinstance(i, int)))
    return CellFit(categories, missing if mask_categories else None, slots, first[-1], MinMax(low, high, fill))


def encoded_cells(df: DataFrame, keys: list[str], categories: list[str], numbers: list[str],
                  mask_categories: bool = False, mask_numbers: bool = False, missing: str = MISSING_TEXT) -> DataFrame:
    """(keys, slot, span, value): the vectors of `fit_vectors` in long form, for any number of categories."""
    return fit_cells(df, categories, numbers, mask_categories, mask_numbers, missing).cells(df, keys)


# -- labels -----------------------------------------------------------------------------------


def fit_labels(df: DataFrame, label: str, limit: int = DENSE_WIDTH) -> OneHot:
    return fit_onehot(df.filter(F.col(label).isNotNull()), [label], None, limit)


def label_id(labels: OneHot) -> Column:
    """0-based index of the row's label, null for an unknown one."""
    [column] = labels.categories
    return F.nullif(labels.place(column), F.lit(0)) - 1


def encoded_labels(df: DataFrame, label: str) -> DataFrame:
    """`df` with `label_id` and the one-hot array `label_vec`."""
    labels = fit_labels(df, label)
    return df.withColumn("label_id", label_id(labels)).withColumn("label_vec", labels.block(label))

