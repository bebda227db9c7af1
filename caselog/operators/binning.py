"""Duration binning: fixed cut plus quantiles, two-phase, and zero / non-zero.

`fit_*` reads a histogram and returns a small binning object (at most a few
boundaries per requested bin); its `apply` is a row expression, so binning a log
needs no shuffle and no join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselog.functions.columns import as_column, number_or_null, step_value, truncated
from caselog.operators.histogram import Histogram

# Fixed value: more short bins than this raise a warning in the guard report.
MANY_SHORT_BINS = 50


# -- fixed cut and quantiles --------------------------------------------------


@dataclass(frozen=True)
class CutoffBinning:
    cut: float
    edges: tuple[float, ...]

    def bin(self, duration: Column | str) -> Column:
        """Bin text: the whole part below the cut, else the lower edge."""
        d = number_or_null(duration)
        lower, upper = self.edges[:-1], self.edges[-1:]
        long = step_value(d, lower, [_whole_text(e) for e in lower])
        inside = F.when(d < F.lit(upper[0]), long) if lower else F.lit(None).cast("string")
        return F.when(d < F.lit(self.cut), truncated(d).cast("long").cast("string")).otherwise(inside)

    def range(self, duration: Column | str) -> Column:
        """Half-open range of the bin as text."""
        d = number_or_null(duration)
        one = as_column(duration)
        short = F.concat(F.lit("["), one.cast("string"), F.lit(", "), (one + 1).cast("string"), F.lit(")"))
        lower, upper = self.edges[:-1], self.edges[1:]
        labels = [f"[{_whole_text(a)}, {_whole_text(b)})" for a, b in zip(lower, upper)]
        inside = (F.when(d < F.lit(upper[-1]), step_value(d, lower, labels))
                  if lower else F.lit(None).cast("string"))
        return F.when(d < F.lit(self.cut), short).otherwise(inside)

    def apply(self, df: DataFrame, duration: str) -> DataFrame:
        return df.withColumns({"bin": self.bin(duration), "bin_range": self.range(duration)})


def _whole_text(value: float) -> str:
    return str(int(value)) if value == int(value) else str(value)


def fit_cutoff(hist: Histogram, cut: float, points: int) -> CutoffBinning:
    """Edges from `points` evenly spaced quantiles of the durations not below `cut`."""
    long = _quantiles_from(hist, cut, points)
    if not long:
        return CutoffBinning(float(cut), ())
    whole = sorted({float(int(v)) for v in long})
    if whole[-1] != hist.summary.highest:
        whole.append(hist.summary.highest)
    later = sorted({v + 1 for v in whole[1:]})
    return CutoffBinning(float(cut), (whole[0], *later))


def _quantiles_from(hist: Histogram, cut: float, points: int) -> list[float]:
    """Quantiles of the values from `cut` on: ranks shift by the rows below it."""
    below = hist.values.filter(F.col("value") < F.lit(float(cut))).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    long_rows = hist.summary.valid - below
    if long_rows <= 0:
        return []
    name = hist.names[0]
    shares = [float(p) for p in np.linspace(0, 1, points)]
    return hist.quantiles({name: shares}, {name: below})[name]


def cutoff_guards(df: DataFrame, duration: str, cut: float, points: int) -> DataFrame:
    """One row telling whether fixed-cut binning can run, and what to look out for.

    `guard` is one of empty, not_numeric, has_null, one_value, few_points, ok.
    """
    if not isinstance(df.schema[duration].dataType, T.NumericType):
        return df.agg(
            F.when(F.count(F.lit(1)) == 0, "empty").otherwise("not_numeric").alias("guard"),
            F.lit(0).cast("long").alias("short_values"),
            F.lit(False).alias("many_short_bins"),
            F.lit(False).alias("duplicate_quantiles"),
        )
    hist = Histogram(df, duration)
    quantiles = _quantiles_from(hist, cut, points) if points >= 2 else []
    sizes = hist.rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("value").alias("distinct"),
        F.count(F.when(F.col("value") < F.lit(float(cut)), 1)).alias("short_values"),
    )
    guard = (
        F.when(F.col("rows") == 0, "empty")
        .when(F.col("distinct") < F.col("rows"), "has_null")
        .when(F.col("distinct") == 1, "one_value")
        .when(F.lit(points < 2), "few_points")
        .otherwise("ok")
    )
    return sizes.select(
        guard.alias("guard"), "short_values",
        (F.col("short_values") > MANY_SHORT_BINS).alias("many_short_bins"),
        F.lit(len(set(quantiles)) < len(quantiles)).alias("duplicate_quantiles"),
    )


def cutoff_bins(df: DataFrame, duration: str, cut: float, points: int,
                hist: Histogram | None = None) -> DataFrame:
    """`df` with `bin` and `bin_range`; unchanged when a guard forbids binning."""
    if not isinstance(df.schema[duration].dataType, T.NumericType) or points < 2:
        return df
    hist = hist or Histogram(df, duration)
    s = hist.summary
    if s.total == 0 or s.valid < s.total or s.distinct == 1:
        return df
    return fit_cutoff(hist, cut, points).apply(df, duration)


# -- two phases -----------------------------------------------------------------


@dataclass(frozen=True)
class TwoPhaseBinning:
    """Own bin below `t_cut`; from there on bins that start at `starts` and end at `last`."""

    t_cut: int
    starts: tuple[float, ...]
    last: float | None
    single_bin: bool = False

    def bin(self, duration: Column | str) -> Column:
        d = number_or_null(duration)
        starts = self.starts
        if not starts and self.single_bin and self.last is not None:
            starts = (self.last,)
        long = step_value(d, starts, [float(int(s)) for s in starts]).cast("double")
        return F.when(d < F.lit(float(self.t_cut)), d).otherwise(long)

    def apply(self, df: DataFrame, duration: str) -> DataFrame:
        return df.withColumn("bin", self.bin(duration))

    @property
    def ranges(self) -> list[tuple[int, int]]:
        if not self.starts:
            return []
        ends = (*self.starts[1:], self.last)
        return [(int(a), int(b)) for a, b in zip(self.starts, ends)]


def bin_starts(hist: Histogram, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """(rank, t_cut, q_bins, value, before) of every bin start for every pair.

    With n long rows, boundary i of q is the element at position i*n div q. A value
    that fills positions [b, u) of the long rows is hit by some i exactly when
    ceil(b*q/n) < ceil(u*q/n), so each histogram row decides for itself and nothing
    has to be sorted, joined or collected per pair. Of a long value table only the
    elements at the boundaries are selected, at most `q_bins` a pair. The largest value closes the
    last bin and starts none.
    """
    t_cuts = sorted({t for t, _, _ in pairs})
    below_all = hist.values.agg(*[
        F.coalesce(F.sum(F.when(F.col("value") < F.lit(float(t)), F.col("n"))), F.lit(0)).alias(f"t{i}")
        for i, t in enumerate(t_cuts)
    ]).first()
    below = {t: below_all[f"t{i}"] for i, t in enumerate(t_cuts)}
    valid = hist.summary.valid
    live = [(t, q, rank) for t, q, rank in pairs if valid > below[t]]
    if hist.long:
        return _selected_starts(hist, live, below)
    cumulative = hist.cumulative()
    if not live:
        live, below = [(t, q, rank) for t, q, rank in pairs], {t: valid - 1 for t in t_cuts}
        cumulative = cumulative.filter(F.lit(False))
    options = ", ".join(f"({rank}, {t}, {q}, {below[t]}L, {valid - below[t]}L)" for t, q, rank in live)
    fields = "array<struct<rank:int,t_cut:int,q_bins:int,below:bigint,long_rows:bigint>>"
    rows = cumulative.select(
        "value", "before", "upto", F.expr(f"inline(cast(array({options}) as {fields}))"))
    last = hist.summary.highest
    first = F.expr("((before - below) * q_bins + long_rows - 1) div long_rows")
    after = F.expr("((upto - below) * q_bins + long_rows - 1) div long_rows")
    return rows.filter(
        (F.col("value") >= F.col("t_cut")) & (F.col("value") < F.lit(last)) & (first < after)
    ).select("rank", "t_cut", "q_bins", "value", "before")


def _selected_starts(hist: Histogram, pairs: list[tuple[int, int, int]], below: dict[int, int]) -> DataFrame:
    name, s = hist.names[0], hist.summary
    ranks = {(t, q): [below[t] + i * (s.valid - below[t]) // q for i in range(q)] for t, q, _ in pairs}
    places = hist.places_at({name: [r for at in ranks.values() for r in at]}).get(name, {})
    rows = [(rank, t, q, value, before) for t, q, rank in pairs
            for value, before in sorted({(places[r].value, places[r].before) for r in ranks[t, q]}) if value < s.highest]
    return hist.rows.sparkSession.createDataFrame(rows, "rank int, t_cut int, q_bins int, value double, before long")


def fit_two_phase(hist: Histogram, t_cut: int, q_bins: int, single_bin: bool = False) -> TwoPhaseBinning:
    t_cut, q_bins = int(t_cut), int(q_bins)
    s = hist.summary
    if not s.valid or s.highest < t_cut:
        return TwoPhaseBinning(t_cut, (), None, single_bin)
    rows = bin_starts(hist, [(t_cut, q_bins, 1)]).select("value").collect()
    return TwoPhaseBinning(t_cut, tuple(sorted(r["value"] for r in rows)), s.highest, single_bin)


def two_phase_bins(df: DataFrame, duration: str, t_cut: int = 5, q_bins: int = 19,
                   hist: Histogram | None = None) -> tuple[DataFrame, TwoPhaseBinning]:
    binning = fit_two_phase(hist or Histogram(df, duration), t_cut, q_bins)
    return binning.apply(df, duration), binning


def two_phase_ranges(hist: Histogram, t_cut: int, q_bins: int) -> DataFrame:
    """(position, lower, upper) of the quantile bins; at most `q_bins` rows."""
    starts = bin_starts(hist, [(int(t_cut), int(q_bins), 1)])
    order = Window.orderBy("value")
    last = F.lit(hist.summary.highest).cast("double")
    return starts.select(
        F.row_number().over(order).cast("long").alias("position"),
        F.col("value").cast("long").alias("lower"),
        F.coalesce(F.lead("value").over(order), last).cast("long").alias("upper"),
    )


# -- zero against non-zero --------------------------------------------------------


def binary_bin(duration: Column | str) -> Column:
    """1 for a positive duration, else 0; a missing one counts as 0."""
    return F.coalesce(number_or_null(duration) > 0, F.lit(False)).cast("int")


# -- reports, all on the per-bin counts -------------------------------------------


def bin_counts(binned: DataFrame, weight: str | None = None) -> DataFrame:
    """(bin, n) of the bins that occur."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return binned.filter(F.col("bin").isNotNull()).groupBy("bin").agg(n.cast("long").alias("n"))


def histogram_bin_counts(hist: Histogram, binning) -> DataFrame:
    """(bin, n) without another pass over the log."""
    return bin_counts(hist.values.select(binning.bin("value").alias("bin"), "n"), "n")


def bin_balance(counts: DataFrame, t_cut: float) -> DataFrame:
    """One row: spread of the quantile bins' sizes, and how many bins of each kind."""
    long = F.col("bin") >= F.lit(t_cut)
    sizes = F.when(long, F.col("n"))
    bins = F.count(sizes)
    return counts.agg(
        F.when(bins > 1, F.max(sizes) - F.min(sizes)).otherwise(F.lit(0)).cast("long").alias("balance"),
        F.count(F.when(~long, 1)).alias("individual_bins"),
        bins.alias("quantile_bins"),
    )


def two_phase_report(counts: DataFrame, t_cut: float) -> DataFrame:
    """One row of sizes for both phases."""
    long = F.col("bin") >= F.lit(t_cut)
    sizes, short = F.when(long, F.col("n")), F.when(~long, F.col("n"))
    own = F.when(~long, F.col("bin"))
    many = F.count(sizes) > 1
    return counts.agg(
        F.count(short).alias("individual_bins"),
        F.count(sizes).alias("quantile_bins"),
        F.when(many, F.avg(sizes)).alias("mean_size"),
        F.when(many, F.stddev_samp(sizes)).alias("std_size"),
        F.when(many, F.min(sizes)).alias("min_size"),
        F.when(many, F.max(sizes)).alias("max_size"),
        F.when(many, F.max(sizes) - F.min(sizes)).alias("balance"),
        F.coalesce(F.sum(short), F.lit(0)).alias("individual_rows"),
        F.min(own).alias("individual_lowest"),
        F.max(own).alias("individual_highest"),
    )


def bin_shares(counts: DataFrame, total: int) -> DataFrame:
    """(bin, n, percent, balance): balance is max - min, given for more than two bins."""
    spread = counts.agg(
        F.when(F.count("bin") > 2, F.max("n") - F.min("n")).cast("long").alias("balance"))
    return counts.select(
        "bin", "n", (F.col("n") / F.lit(total) * 100).alias("percent"), spread.scalar().alias("balance"))


def binary_ratio(counts: DataFrame) -> DataFrame:
    """One row: rows of bin 0 and 1 (0 if absent) and the larger over the smaller."""
    zero = F.coalesce(F.sum(F.when(F.col("bin") == 0, F.col("n"))), F.lit(0))
    other = F.coalesce(F.sum(F.when(F.col("bin") == 1, F.col("n"))), F.lit(0))
    return counts.agg(zero.alias("zero_rows"), other.alias("nonzero_rows")).withColumn(
        "ratio",
        F.when(F.least("zero_rows", "nonzero_rows") > 0,
               F.greatest("zero_rows", "nonzero_rows") / F.least("zero_rows", "nonzero_rows")),
    )


def cutoff_report(hist: Histogram, binning: CutoffBinning) -> DataFrame:
    """(bin, n, lower, upper): rows per bin; the cut-offs for the quantile bins."""
    counts = histogram_bin_counts(hist, binning)
    lower = F.col("bin").cast("double")
    if len(binning.edges) < 2:
        upper = F.lit(None).cast("double")
    else:
        upper = step_value(lower, binning.edges[:-1], list(binning.edges[1:]))
    quantile = lower >= F.lit(binning.cut)
    return counts.select(
        "bin", "n", F.when(quantile, lower).alias("lower"), F.when(quantile, upper).alias("upper"))

