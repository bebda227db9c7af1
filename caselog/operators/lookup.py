"""Joins of rows with a table of one row per key, at any size of either side and any share of a key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.constants import BROADCAST_BYTES, HOT_SHARE

FIXED_BYTES = 64  # of a row besides its texts


def row_bytes(texts: list[str]) -> Column:
    """About the size of a row with these text columns."""
    return F.lit(FIXED_BYTES) + sum((F.coalesce(F.octet_length(t), F.lit(0)) for t in texts), F.lit(0))


@dataclass(frozen=True)
class Lookup:
    """A stored table of unique keys, with `n`, the number of rows that hold the key.

    Up to `limit` bytes (`size`, measured on the table) it goes to all executors.
    Beyond, only keys of over a `HOT_SHARE`th of all rows do: there are fewer than
    `HOT_SHARE`, and their rows stay where they are; the rest meets by key.
    """

    table: DataFrame
    keys: list[str]
    rows: int
    size: int
    limit: int = BROADCAST_BYTES

    def join(self, rows: DataFrame, keep: bool = False) -> DataFrame:
        """`rows` that have a row in the table, with its other columns but `n`. Null equals null.

        With `keep`, rows without one stay, with nulls.
        """
        how = "left" if keep else "inner"
        if self.size <= self.limit:
            return self._matched(rows, F.broadcast(self.table), how)
        total = self.table.agg(F.sum("n")).scalar()
        hot = F.broadcast(self.table.filter(F.col("n") * HOT_SHARE > total))
        cold = self.table.filter(F.col("n") * HOT_SHARE <= total)
        others = rows.join(self._renamed(hot), self._match(rows), "left_anti")
        return self._matched(rows, hot, "inner").unionByName(self._matched(others, cold, how))

    def _renamed(self, table: DataFrame) -> DataFrame:
        return table.withColumnsRenamed({k: f"__key_{k}" for k in self.keys})

    def _match(self, rows: DataFrame) -> Column:
        found = F.lit(True)
        for k in self.keys:
            found = found & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
        return found

    def _matched(self, rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
        return rows.join(self._renamed(table.drop("n")), self._match(rows), how).drop(*[f"__key_{k}" for k in self.keys])


def fit_lookup(table: DataFrame, keys: list[str], limit: int = BROADCAST_BYTES) -> Lookup:
    """Measures the stored `table`: rows, and the bytes of its text keys."""
    texts = [k for k in keys if table.schema[k].dataType.simpleString() == "string"]
    row = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(texts)), F.lit(0)).alias("size")).first()
    return Lookup(table, keys, row["rows"], row["size"], limit)
