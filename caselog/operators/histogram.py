"""Value counts of numeric columns.

Every statistic of a duration column (quantiles, prefix shares, boundaries) is a
function of its value counts. They are counted once, map-side first, and kept in
the shared folder; all later questions read this much smaller table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.constants import SMALL_ROWS
from caselog.functions.columns import number_or_null, step_value
from caselog.operators.ordered import Ordered, Total
from caselog.session import cut

BUCKETS = 4096   # of a range of values, counted at once
RANGES = 64      # ordered at once, a task each


@dataclass(frozen=True)
class Summary:
    total: int                  # rows, missing ones included
    valid: int                  # rows with a value
    distinct: int
    lowest: float | None
    highest: float | None


@dataclass(frozen=True)
class Place:
    """A value, and the rows below it and up to it."""

    value: float
    before: int
    upto: int


@dataclass(frozen=True)
class _Range:
    """Values of a column from `low` to `high`, the rows below them, and the wanted ranks among them."""

    name: str
    low: float
    high: float
    before: int
    ranks: list[int]


class Histogram:
    """Value counts (name, value, n) of one or more columns; null counts missing rows."""

    def __init__(self, df: DataFrame, columns: str | list[str] | dict[str, Column],
                 limit: int = SMALL_ROWS):
        if isinstance(columns, str):
            columns = [columns]
        if not isinstance(columns, dict):
            columns = {c: F.col(c) for c in columns}
        cells = F.explode(F.array(*[
            F.struct(F.lit(name).alias("name"), number_or_null(c).alias("value"))
            for name, c in columns.items()
        ]))
        counts = (
            df.select(cells.alias("cell")).select("cell.name", "cell.value")
            .groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
        )
        self._hold(cut(counts), list(columns), limit)

    @classmethod
    def counted(cls, rows: DataFrame, names: list[str], limit: int = SMALL_ROWS) -> Histogram:
        """Of stored counts (name, value, n)."""
        made = cls.__new__(cls)
        made._hold(rows, names, limit)
        return made

    def _hold(self, rows: DataFrame, names: list[str], limit: int) -> None:
        self.rows, self.names, self.limit = rows, names, limit
        self.summaries = self._summaries()
        self._cumulative: DataFrame | None = None

    def _summaries(self) -> dict[str, Summary]:
        rows = self.rows.groupBy("name").agg(
            F.sum("n").alias("total"),
            F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("valid"),
            F.count("value").alias("distinct"),
            F.min("value").alias("lowest"),
            F.max("value").alias("highest"),
        ).collect()
        found = {r["name"]: Summary(*[r[f] for f in ("total", "valid", "distinct", "lowest", "highest")])
                 for r in rows}
        return {name: found.get(name, Summary(0, 0, 0, None, None)) for name in self.names}

    @property
    def summary(self) -> Summary:
        return self.summaries[self.names[0]]

    @property
    def values(self) -> DataFrame:
        return self.rows.filter(F.col("value").isNotNull())

    def cumulative(self) -> DataFrame:
        """(name, value, n, before, upto): rows below the value, and up to it.

        Ordered once and kept, so that later questions only filter this table.
        """
        if self._cumulative is None:
            longest = max(s.distinct for s in self.summaries.values())
            running = Ordered(self.values, ["name"], ["value"], longest, self.limit)
            self._cumulative = cut(running.add(upto=Total(F.col("n"))).result().withColumn(
                "before", F.col("upto") - F.col("n")))
        return self._cumulative

    def smallest(self, count: int) -> DataFrame:
        """The `count` smallest distinct values of a single-column histogram."""
        return self.values.orderBy("value").limit(count)

    @property
    def long(self) -> bool:
        """Whether a column has more distinct values than one task may order."""
        return max((s.distinct for s in self.summaries.values()), default=0) > self.limit

    def values_at(self, ranks: dict[str, list[int]]) -> dict[str, dict[int, float]]:
        """Elements at 0-based sorted positions, by column."""
        return {name: {r: p.value for r, p in found.items()} for name, found in self.places_at(ranks).items()}

    def places_at(self, ranks: dict[str, list[int]]) -> dict[str, dict[int, Place]]:
        """The value at each 0-based sorted position, and the rows below and up to it, by column."""
        wanted = {name: sorted(set(r)) for name, r in ranks.items() if r}
        if not wanted:
            return {}
        spans = [self.summaries[n].highest - self.summaries[n].lowest for n in wanted]
        # Ranges that have no width as a number cannot be cut.
        return self._selected(wanted) if self.long and all(map(math.isfinite, spans)) else self._looked_up(wanted)

    def _looked_up(self, wanted: dict[str, list[int]]) -> dict[str, dict[int, Place]]:
        hits = None
        for name, positions in wanted.items():
            asked = F.expr("array(" + ", ".join(f"{p}L" for p in positions) + ")")
            inside = F.filter(asked, lambda p: (p >= F.col("before")) & (p < F.col("upto")))
            here = F.when(F.col("name") == name, inside)
            hits = here if hits is None else F.coalesce(hits, here)
        found = self.cumulative().select("name", "value", "before", "upto", F.explode(hits).alias("position")).collect()
        result: dict[str, dict[int, Place]] = {name: {} for name in wanted}
        for row in found:
            result[row["name"]][row["position"]] = Place(row["value"], row["before"], row["upto"])
        return result

    def _selected(self, wanted: dict[str, list[int]]) -> dict[str, dict[int, Place]]:
        """Selection by buckets: the value table is counted, never sorted or shuffled whole.

        A range of values is cut into equal buckets, whose counts come to the
        driver (`BUCKETS` a range). Of each bucket that holds a wanted rank, only its own
        values are looked at next: cut again while there are too many, else ordered.
        """
        result: dict[str, dict[int, Place]] = {name: {} for name in wanted}
        open_ranges: list[_Range] = []
        short: list[_Range] = []
        for name, ranks in wanted.items():
            s = self.summaries[name]
            if s.lowest == s.highest:
                result[name] = dict.fromkeys(ranks, Place(s.lowest, 0, s.valid))
            else:
                (short if s.distinct <= self.limit else open_ranges).append(_Range(name, s.lowest, s.highest, 0, ranks))
        while open_ranges:
            found: dict[int, list] = {}
            part = F.floor((F.col("value") - F.col("low")) / F.col("width") * BUCKETS).cast("int")
            counted = self._inside(open_ranges).groupBy("at", F.least(part, F.lit(BUCKETS - 1)).alias("bucket")).agg(
                F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"), F.min("value").alias("low"),
                F.max("value").alias("high"))
            for row in counted.collect():
                found.setdefault(row["at"], []).append(row)
            later = []
            for at, buckets in found.items():
                given = open_ranges[at]
                before = given.before
                for b in sorted(buckets, key=lambda r: r["low"]):
                    ranks = [r for r in given.ranks if before <= r < before + b["rows"]]
                    if ranks and b["low"] == b["high"]:
                        place = Place(b["low"], before, before + b["rows"])
                        result[given.name] |= dict.fromkeys(ranks, place)
                    elif ranks:
                        (short if b["distinct"] <= self.limit else later).append(
                            _Range(given.name, b["low"], b["high"], before, ranks))
                    before += b["rows"]
            open_ranges = later
        for at in range(0, len(short), RANGES):
            self._ordered_ranges(short[at:at + RANGES], result)
        return result

    def _inside(self, ranges: list[_Range]) -> DataFrame:
        """The values inside one of the ranges (which share none), with `at`, its number, and `low` and `width`."""
        at = None
        for name in {r.name for r in ranges}:
            own = sorted((r.low, k) for k, r in enumerate(ranges) if r.name == name)
            here = F.when(F.col("name") == name, step_value(F.col("value"), [low for low, _ in own], [k for _, k in own]))
            at = here if at is None else F.coalesce(at, here)
        low, high = (F.get(F.lit([float(getattr(r, k)) for r in ranges]), F.col("at")) for k in ("low", "high"))
        rows = self.values.withColumn("at", at).withColumn("low", low).withColumn("high", high)
        return rows.filter(F.col("value") <= F.col("high")).withColumn("width", F.col("high") - F.col("low"))

    def _ordered_ranges(self, ranges: list[_Range], result: dict[str, dict[int, Place]]) -> None:
        so_far = Window.partitionBy("at").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = F.get(F.lit([r.before for r in ranges]).cast("array<long>"), F.col("at"))
        rows = self._inside(ranges).withColumn("upto", before + F.sum("n").over(so_far))
        asked = F.get(F.array(*[F.lit(r.ranks).cast("array<long>") for r in ranges]), F.col("at"))
        hits = F.filter(asked, lambda p: (p >= F.col("upto") - F.col("n")) & (p < F.col("upto")))
        found = rows.select("at", "value", "n", "upto", F.explode(hits).alias("position"))
        for row in found.collect():
            result[ranges[row["at"]].name][row["position"]] = Place(row["value"], row["upto"] - row["n"], row["upto"])

    def quantiles(self, shares: dict[str, list[float]],
                  skip: dict[str, int] | None = None) -> dict[str, list[float]]:
        """Linearly interpolated quantiles, exact, by column.

        `skip` leaves out that many smallest rows. The two neighbours of each
        quantile come from the distributed counts.
        """
        places: dict[str, list[tuple[int, int, float]]] = {}
        for name, wanted in shares.items():
            first = (skip or {}).get(name, 0)
            rows = self.summaries[name].valid - first
            places[name] = []
            for share in wanted if rows > 0 else []:
                position = (rows - 1) * share
                low = int(position)
                places[name].append((first + low, first + min(low + 1, rows - 1), position - low))
        found = self.values_at({n: [r for p in at for r in p[:2]] for n, at in places.items()})
        return {
            name: [_between(found[name][low], found[name][high], weight) for low, high, weight in at]
            for name, at in places.items()
        }


def _between(low: float, high: float, weight: float) -> float:
    """Starts from the nearer neighbour: callers truncate, so the last digit decides."""
    if weight < 0.5:
        return low + (high - low) * weight
    return high - (high - low) * (1 - weight)
