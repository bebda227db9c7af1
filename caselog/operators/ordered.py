"""Running values along ordered rows, with or without a key.

While a key's rows fit one task, these are plain window functions. Rows of longer
keys, and of those only, are sorted globally by (key, order): the sort splits a
long key over many partitions, each partition runs the same windows on its part of
a key, and what the earlier parts hand on is added from a table that has a row
only where a key continues from the partition before. Both ways give the same
values.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.constants import SMALL_ROWS
from caselog.session import cut

PART, ROW, AT, BEFORE = "__part", "__row", "__at", "__before"


@dataclass(frozen=True)
class Position:
    """0-based position inside the key."""

    def local(self, so_far) -> Column:
        return F.col(AT) - 1

    def summary(self) -> Column:
        return F.lit(None)

    def carried(self, summary: str, before) -> Column:
        return F.lit(None)

    def combined(self, local: Column, carry: Column) -> Column:
        return local + F.coalesce(BEFORE, F.lit(0))


@dataclass(frozen=True)
class Total:
    """Running sum of an amount, this row included."""

    amount: Column

    def local(self, so_far) -> Column:
        return F.sum(self.amount).over(so_far)

    def summary(self) -> Column:
        return F.sum(self.amount)

    def carried(self, summary: str, before) -> Column:
        return F.sum(summary).over(before)

    def combined(self, local: Column, carry: Column) -> Column:
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(local + carry)


@dataclass(frozen=True)
class Previous:
    """The column's value in the row before, null at the start of a key."""

    column: str

    def local(self, so_far) -> Column:
        value = F.struct(F.col(self.column).alias("v"))
        return F.lag(value).over(so_far.rowsBetween(-1, -1))

    def summary(self) -> Column:
        return F.max_by(F.struct(F.col(self.column).alias("v")), ROW)

    def carried(self, summary: str, before) -> Column:
        return F.last(summary).over(before)

    def combined(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local, carry)


@dataclass(frozen=True)
class LastFlagged:
    """1-based position of the last flagged row so far."""

    flag: str

    def local(self, so_far) -> Column:
        return F.max(F.when(F.col(self.flag), F.col(AT))).over(so_far)

    def summary(self) -> Column:
        return F.max(F.when(F.col(self.flag), F.col(AT)))

    def carried(self, summary: str, before) -> Column:
        return F.max(F.col(summary) + F.coalesce(BEFORE, F.lit(0))).over(before)

    def combined(self, local: Column, carry: Column) -> Column:
        return F.coalesce(local + F.coalesce(BEFORE, F.lit(0)), carry)


class Ordered:
    """`df` ordered by `order` inside `keys`; `longest` is the longest key's row count.

    `short` holds the rows of keys that one task may order, `long` the others, sorted
    and kept; either may be None.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column | str],
                 longest: int, limit: int = SMALL_ROWS):
        self.keys = keys
        self.split = longest > limit
        self.short, self.long = df, None
        if self.split:
            long = df
            self.short = None
            if keys:
                sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit)
                # At most one row per `limit` rows of the log.
                found = F.broadcast(cut(sizes.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]), "long"))
                match = [df[k].eqNullSafe(found[f"__key{i}"]) for i, k in enumerate(keys)]
                long, self.short = df.join(found, match, "left_semi"), df.join(found, match, "left_anti")
            # The written table fixes the row numbers: a sort that runs again after a
            # loss may place its partition borders elsewhere.
            fixed = cut(long.orderBy(*keys, *order).withColumn(ROW, F.monotonically_increasing_id()), "sorted")
            self.long = fixed.withColumn(PART, F.shiftright(ROW, 33))
        self.short_window = Window.partitionBy(*keys).orderBy(*order)
        self.long_window = Window.partitionBy(PART, *keys).orderBy(ROW)

    def with_column(self, name: str, value: Column) -> Ordered:
        """A column computed row by row, for what is added next."""
        self.short = None if self.short is None else self.short.withColumn(name, value)
        self.long = None if self.long is None else self.long.withColumn(name, value)
        return self

    def add(self, **wanted) -> Ordered:
        """Add columns; those added together share one pass."""
        if self.short is not None:
            self.short = self._finished(self._local(self.short, self.short_window, wanted)[1], wanted)
        if self.long is not None:
            rows, local = self._local(self.long, self.long_window, wanted)
            self.long = self._finished(self._carry(rows, local, wanted), wanted)
        return self

    def _local(self, df: DataFrame, window, wanted: dict) -> tuple[DataFrame, DataFrame]:
        so_far = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = df.withColumn(AT, F.row_number().over(window).cast("long"))
        return rows, rows.withColumns({name: w.local(so_far) for name, w in wanted.items()})

    def _finished(self, local: DataFrame, wanted: dict) -> DataFrame:
        plain = {n: F.col(n)["v"] for n, w in wanted.items() if isinstance(w, Previous)}
        return local.withColumns(plain).drop(AT) if plain else local.drop(AT)

    def _carry(self, rows: DataFrame, local: DataFrame, wanted: dict) -> DataFrame:
        parts = rows.groupBy(PART, *self.keys).agg(
            F.count(F.lit(1)).alias("__rows"),
            *[w.summary().alias(f"__s_{name}") for name, w in wanted.items()])
        before = Window.partitionBy(*self.keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
        carry = (
            parts.withColumn(BEFORE, F.sum("__rows").over(before))
            .withColumns({f"__c_{n}": w.carried(f"__s_{n}", before) for n, w in wanted.items()})
            .filter(F.col(BEFORE).isNotNull())
            .select(PART, *self.keys, BEFORE, *[f"__c_{n}" for n in wanted])
        )
        # At most one key continues into a partition: one row per partition.
        joined = local.join(F.broadcast(carry), [PART, *self.keys], "left")
        return joined.withColumns(
            {n: w.combined(F.col(n), F.col(f"__c_{n}")) for n, w in wanted.items()}
        ).drop(BEFORE, *[f"__c_{n}" for n in wanted])

    def result(self) -> DataFrame:
        parts = [p.drop(PART, ROW) for p in (self.short, self.long) if p is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
