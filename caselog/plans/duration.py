"""Duration binning from end to end, with fixed, searched or chosen parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from caselog.operators.binning import (
    TwoPhaseBinning,
    binary_bin,
    fit_two_phase,
    histogram_bin_counts,
    two_phase_report,
)
from caselog.operators.histogram import Histogram
from caselog.operators.search import (
    BINARY,
    PRESERVE,
    detected_phases,
    find_parameters,
    reported_cut,
    zero_pattern,
)


@dataclass(frozen=True)
class BinaryBinning:
    def bin(self, duration):
        return binary_bin(duration)

    def apply(self, df: DataFrame, duration: str) -> DataFrame:
        return df.withColumn("bin", self.bin(duration))


@dataclass(frozen=True)
class Binned:
    """The binned log (not run yet), how it was binned, and one-row facts about it."""

    events: DataFrame
    binning: TwoPhaseBinning | BinaryBinning
    hist: Histogram
    facts: dict = field(default_factory=dict)

    def counts(self) -> DataFrame:
        return histogram_bin_counts(self.hist, self.binning)

    def report(self) -> DataFrame:
        return two_phase_report(self.counts(), self.facts["t_cut"])


def _binned(df, duration, hist, binning, **facts) -> Binned:
    return Binned(binning.apply(df, duration), binning, hist, facts)


def two_phase(df: DataFrame, duration: str, t_cut: int | None = 5, q_bins: int | None = 19,
              optimize: bool = True, hist: Histogram | None = None) -> Binned:
    """Two-phase binning; parameters are searched only if one of them is None."""
    hist = hist or Histogram(df, duration)
    if optimize and (t_cut is None or q_bins is None):
        found = find_parameters(hist)
        binning = fit_two_phase(hist, found.t_cut, found.q_bins)
        cut = reported_cut(hist, binning).first()["t_cut"]
        return _binned(df, duration, hist, binning,
                       t_cut=t_cut if cut is None else cut, q_bins=len(binning.ranges), searched=found)
    return _binned(df, duration, hist, fit_two_phase(hist, t_cut, q_bins), t_cut=t_cut, q_bins=q_bins)


def automatic(df: DataFrame, duration: str, target: int | None = None,
              hist: Histogram | None = None) -> Binned:
    """Two-phase binning with searched parameters; the phases are read back from the result."""
    hist = hist or Histogram(df, duration)
    found = find_parameters(hist, target=target)
    binning = fit_two_phase(hist, found.t_cut, found.q_bins)
    phases = detected_phases(hist, binning).first()
    return _binned(df, duration, hist, binning,
                   t_cut=phases["t_cut"], q_bins=phases["q_bins"], searched=found)


def chosen(df: DataFrame, duration: str, zero_threshold: float = 0.6, target: int | None = None,
           hist: Histogram | None = None) -> Binned:
    """Look at the zeros and small values first, then bin by the strategy that fits."""
    hist = hist or Histogram(df, duration)
    analysis: Row = zero_pattern(hist, zero_threshold).first()
    facts = {"strategy": analysis["strategy"], "analysis": analysis}
    if analysis["strategy"] == BINARY:
        return _binned(df, duration, hist, BinaryBinning(), **facts)
    if analysis["strategy"] == PRESERVE:
        t_cut, q_bins = analysis["t_cut"], analysis["q_bins"]
        return _binned(df, duration, hist, fit_two_phase(hist, t_cut, q_bins),
                       t_cut=t_cut, q_bins=q_bins, **facts)
    found = find_parameters(hist, target=target)
    return _binned(df, duration, hist, fit_two_phase(hist, found.t_cut, found.q_bins),
                   t_cut=found.t_cut, q_bins=found.q_bins, searched=found, **facts)


def bin_durations(df: DataFrame, duration: str, zero_threshold: float = 0.6,
                  target: int | None = None) -> DataFrame:
    """The binned log only."""
    return chosen(df, duration, zero_threshold, target).events


def with_minutes(df: DataFrame, seconds: str, name: str = "duration_min") -> DataFrame:
    return df.withColumn(name, F.ceil(F.col(seconds).cast("double") / F.lit(60.0)).cast("double"))
