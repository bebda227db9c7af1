import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselog.operators import binning as b
from caselog.operators.histogram import Histogram
from caselog.plans.duration import BinaryBinning

VALUES = [0, 0, 1, 3, 3, 4, 5, 6, 6, 7, 9, 12, 12, 15, 40, 41, 100]


def frame(spark, values, kind="double"):
    cast = float if kind == "double" else int
    rows = [(i, None if v is None else cast(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i int, d {kind}")


def bins(df, name="bin"):
    return [r[name] for r in df.orderBy("i").collect()]


def brute_two_phase(values, t_cut, q):
    long = sorted(v for v in values if v >= t_cut)
    if not long:
        return [v if v < t_cut else None for v in values]
    marks = [long[(i * len(long)) // q] for i in range(q)] + [long[-1]]
    marks = sorted(set(marks))

    def place(v):
        if v < t_cut:
            return v
        for i in range(len(marks) - 1):
            last = i == len(marks) - 2
            if marks[i] <= v < marks[i + 1] or (last and v == marks[-1]):
                return float(int(marks[i]))
        return None

    return [place(v) for v in values]


@pytest.mark.parametrize("limit", [100_000, 3])
@pytest.mark.parametrize("t_cut,q,starts,expected", [
    (5, 3, (5, 7, 15), [0, 0, 1, 3, 3, 4, 5, 5, 5, 7, 7, 7, 7, 15, 15, 15, 15]),
    (5, 4, (5, 6, 12, 40), [0, 0, 1, 3, 3, 4, 5, 6, 6, 6, 6, 12, 12, 12, 40, 40, 40]),
    (41, 2, (41,), [0, 0, 1, 3, 3, 4, 5, 6, 6, 7, 9, 12, 12, 15, 40, 41, 41]),
    (100, 3, (), [0, 0, 1, 3, 3, 4, 5, 6, 6, 7, 9, 12, 12, 15, 40, 41, None]),
])
def test_two_phase_golden(spark, limit, t_cut, q, starts, expected):
    df = frame(spark, VALUES)
    binning = b.fit_two_phase(Histogram(df, "d", limit), t_cut, q)
    assert binning.starts == starts
    assert bins(binning.apply(df, "d")) == expected


def test_two_phase_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(4):
        values = [float(int(rng.expovariate(0.02))) for _ in range(300)]
        hist = Histogram(frame(spark, values), "d", rng.choice([10, 100_000]))
        for t_cut, q in [(0, 7), (5, 19), (20, 3), (60, 40)]:
            binning = b.fit_two_phase(hist, t_cut, q)
            assert bins(binning.apply(frame(spark, values), "d")) == brute_two_phase(values, t_cut, q)


def test_single_long_value(spark):
    df = frame(spark, [1, 2, 9, 9])
    hist = Histogram(df, "d")
    assert bins(b.fit_two_phase(hist, 5, 3).apply(df, "d")) == [1, 2, None, None]
    assert bins(b.fit_two_phase(hist, 5, 3, single_bin=True).apply(df, "d")) == [1, 2, 9, 9]
    assert bins(b.fit_two_phase(hist, 50, 3).apply(df, "d")) == [1, 2, 9, 9]


def test_missing_durations(spark):
    df = spark.createDataFrame([(0, 1.0), (1, None), (2, float("nan")), (3, 8.0), (4, 9.0)], "i int, d double")
    hist = Histogram(df, "d")
    assert (hist.summary.total, hist.summary.valid) == (5, 3)
    assert bins(b.fit_two_phase(hist, 5, 2).apply(df, "d")) == [1, None, None, 8, 8]
    assert bins(BinaryBinning().apply(df, "d")) == [1, 0, 0, 1, 1]


@pytest.mark.parametrize("limit", [100_000, 3])
def test_cutoff_golden(spark, limit):
    df = frame(spark, VALUES)
    binning = b.fit_cutoff(Histogram(df, "d", limit), 5, 4)
    assert binning.edges == (5, 8, 14, 101)
    out = binning.apply(df, "d")
    assert bins(out) == "0 0 1 3 3 4 5 5 5 5 8 8 8 14 14 14 14".split()
    assert bins(out, "bin_range")[0] == "[0.0, 1.0)"
    assert bins(out, "bin_range")[-1] == "[14, 101)"
    ints = frame(spark, VALUES, "int")
    assert bins(binning.apply(ints, "d"), "bin_range")[0] == "[0, 1)"


def test_cutoff_quantiles_match_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.ceil(rng.exponential(40, 500))
    hist = Histogram(frame(spark, values.tolist()), "d")
    for cut, points in [(5, 24), (10, 7), (0, 11)]:
        whole = np.unique(np.quantile(values[values >= cut], np.linspace(0, 1, points)).astype(int)).astype(float)
        if whole[-1] != values.max():
            whole = np.append(whole, values.max())
        expected = [whole[0], *np.unique(whole[1:] + 1)]
        assert list(b.fit_cutoff(hist, cut, points).edges) == expected


def test_cutoff_special_cases(spark):
    df = frame(spark, [1, 2, 9, 9])
    assert bins(b.cutoff_bins(df, "d", 5, 4)) == ["1", "2", None, None]       # one edge
    assert bins(b.cutoff_bins(df, "d", 50, 4)) == ["1", "2", "9", "9"]        # nothing above the cut
    half = frame(spark, [1, 6.5, 7, 9.5])
    assert bins(b.cutoff_bins(half, "d", 5, 3)) == ["1", "6", "6", "8"]
    for unchanged in (b.cutoff_bins(frame(spark, [4, 4]), "d", 5, 4),
                      b.cutoff_bins(frame(spark, [4, None]), "d", 5, 4),
                      b.cutoff_bins(df, "d", 5, 1),
                      b.cutoff_bins(df.withColumn("d", F.col("d").cast("string")), "d", 5, 4)):
        assert "bin" not in unchanged.columns


@pytest.mark.parametrize("values,points,guard", [
    ([], 4, "empty"), ([1, None], 4, "has_null"), ([4, 4], 4, "one_value"),
    ([1, 2], 1, "few_points"), (VALUES, 4, "ok"),
])
def test_guards(spark, values, points, guard):
    assert b.cutoff_guards(frame(spark, values), "d", 5, points).first()["guard"] == guard


def test_duplicate_quantiles(spark):
    rows = [(b.cutoff_guards(frame(spark, v), "d", 0, 5).first()["duplicate_quantiles"]) for v in ([1, 1, 1, 9], VALUES)]
    assert rows == [True, False]


def test_many_short_bins(spark):
    row = b.cutoff_guards(frame(spark, list(range(80))), "d", 60, 4).first()
    assert (row["short_values"], row["many_short_bins"]) == (60, True)


def test_reports(spark):
    df = frame(spark, VALUES)
    hist = Histogram(df, "d")
    binning = b.fit_two_phase(hist, 5, 4)
    counts = b.histogram_bin_counts(hist, binning)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, b.bin_counts(binning.apply(df, "d")).collect()))
    assert tuple(b.bin_balance(counts, 5).first()) == (3, 4, 4)
    report = b.two_phase_report(counts, 5).first()
    assert (report["mean_size"], report["min_size"], report["max_size"]) == (2.75, 1, 4)
    assert (report["individual_rows"], report["individual_lowest"], report["individual_highest"]) == (6, 0, 4)
    shares = b.bin_shares(counts, 17).collect()
    assert sum(r["percent"] for r in shares) == pytest.approx(100) and {r["balance"] for r in shares} == {3}
    few = b.histogram_bin_counts(Histogram(frame(spark, [0, 0, 0]), "d"), BinaryBinning())
    assert tuple(b.binary_ratio(few).first()) == (3, 0, None)
    assert {r["balance"] for r in b.bin_shares(few, 3).collect()} == {None}


def test_every_long_duration_gets_one_bin(spark):
    rng = random.Random(11)
    values = [float(rng.randrange(200)) for _ in range(500)]
    df = frame(spark, values)
    binned = b.fit_two_phase(Histogram(df, "d"), 10, 8).apply(df, "d")
    assert binned.filter(F.col("bin").isNull()).count() == 0
    assert b.bin_counts(binned).agg(F.sum("n")).first()[0] == 500
