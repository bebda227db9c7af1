"""Event-log descriptor and the case table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class EventLog:
    """Names the columns that make a DataFrame an event log.

    `order` must be unique within a case: rows of a DataFrame have no order of
    their own, so every sequence operator sorts by it.
    """

    case: str
    activity: str
    order: tuple[str, ...]
    start: str | None = None

    def order_key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order])

    def row_key(self) -> Column:
        """Order over the whole log: cases by key, events by `order`."""
        return F.struct(F.col(self.case), *[F.col(c) for c in self.order])


@dataclass(frozen=True)
class CaseProfile:
    events: int
    cases: int
    longest: int


def with_case(df: DataFrame, log: EventLog) -> DataFrame:
    """Events without a case key belong to no sequence."""
    return df.filter(F.col(log.case).isNotNull())


def case_lengths(df: DataFrame, log: EventLog) -> DataFrame:
    """(case, len): events per case, counted map-side first."""
    return with_case(df, log).groupBy(log.case).agg(F.count(F.lit(1)).alias("len"))


def case_profile(df: DataFrame, log: EventLog) -> CaseProfile:
    """One row of sizes; reads the case column only."""
    row = case_lengths(df, log).agg(
        F.coalesce(F.sum("len"), F.lit(0)).alias("events"),
        F.count(F.lit(1)).alias("cases"),
        F.coalesce(F.max("len"), F.lit(0)).alias("longest"),
    ).first()
    return CaseProfile(row["events"], row["cases"], row["longest"])


def case_table(df: DataFrame, log: EventLog, columns: list[str]) -> DataFrame:
    """One row per case: the first non-null value of each column in event order."""
    key = log.order_key()
    return with_case(df, log).groupBy(log.case).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns]
    )
