import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from caselog.operators import search as s
from caselog.operators.histogram import Histogram
from caselog.plans import duration as plans
from test_binning import brute_two_phase


@pytest.fixture(scope="module")
def columns(spark, testdata):
    """Columns whose search results are known."""
    lines = spark.read.parquet(f"{testdata}/sf0.01/lineitem.parquet")
    events = spark.read.parquet(f"{testdata}/sf0.01/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.ceil((F.lead(micros).over(order) - micros) / F.lit(6e7))
    return {
        "qty": lines.select(F.col("l_quantity").alias("d")),
        "over35": lines.select(F.greatest(F.lit(0.0), F.col("l_quantity") - 35).alias("d")),
        "over45": lines.select(F.greatest(F.lit(0.0), F.col("l_quantity") - 45).alias("d")),
        "gap": events.select(F.coalesce(gap, F.lit(0)).cast("double").alias("d")),
    }


@pytest.mark.parametrize("name,cutoff,small,strategy,t_cuts,target,q_bins", [
    ("qty", 11, 20.3, s.STANDARD, [4, 6, 9, 11, 14], 30, [14, 16, 17, 18, 19, 21, 22, 23, 24, 26, 28]),
    ("over35", 16, 29.68, s.PRESERVE, [16], 16, [5, 7]),
    ("over45", 6, 9.95, s.BINARY, [6], 6, [5, 7]),
    ("gap", 2, 0.15, s.STANDARD, [3, 5, 7, 10], 30, [10, 15, 20, 25]),
])
def test_strategy_golden(columns, name, cutoff, small, strategy, t_cuts, target, q_bins):
    hist = Histogram(columns[name], "d")
    row = s.zero_pattern(hist, 0.6).first()
    assert (row["cutoff"], row["strategy"]) == (cutoff, strategy)
    assert row["small_percent"] == pytest.approx(small, abs=0.01)
    if name == "over35":
        assert (row["t_cut"], row["q_bins"]) == (16, 8)
    found = s.suggestions(hist).first()
    assert found["t_cuts"] == t_cuts and found["target"] == target
    assert found["q_bins"] == q_bins


@pytest.mark.parametrize("name,t_cuts,q_bins,best,scores", [
    ("qty", [4, 6, 9], [5, 10, 15], (9, 5, 1212), [1226, 1389, 1320, 2093, 1357, 2286, 1212, 1302, 1266]),
    ("gap", [3, 5, 7, 10], [10, 15, 20, 25], (5, 15, 14),
     [23, 27, 23, 19, 18, 14, 17, 19, 18, 19, 21, 18, 19, 22, 18, 15]),
])
def test_search_golden(columns, name, t_cuts, q_bins, best, scores):
    hist = Histogram(columns[name], "d")
    pairs = [tuple(r) for r in s.parameter_grid(s.search_ranges(hist, t_cuts, q_bins)).collect()]
    assert [r["score"] for r in s.pair_scores(hist, pairs).orderBy("rank").collect()] == scores
    found = s.find_parameters(hist, t_cuts, q_bins)
    assert (found.t_cut, found.q_bins, found.score) == best


def test_scores_against_brute_force(spark):
    rng = random.Random(2)
    values = [float(int(rng.expovariate(0.05))) for _ in range(400)]
    hist = Histogram(spark.createDataFrame([(v,) for v in values], "d double"), "d")
    pairs = [(t, q, i + 1) for i, (t, q) in enumerate((t, q) for t in (2, 10, 60, 500) for q in (3, 8, 60))]
    got = {r["rank"]: (r["bins"], r["balance"], r["score"]) for r in s.pair_scores(hist, pairs).collect()}
    for t, q, rank in pairs:
        sizes = {}
        for v, bin_ in zip(values, brute_two_phase(values, t, q)):
            if v >= t and bin_ is not None:
                sizes[bin_] = sizes.get(bin_, 0) + 1
        spread = max(sizes.values()) - min(sizes.values()) if len(sizes) > 1 else 0
        penalty = 1000 if len(sizes) < 3 else 100 if len(sizes) > 50 else 0
        assert got[rank] == (len(sizes), spread, spread + penalty)


def test_first_good_pair_wins(spark):
    rows = [(5, 10, 1, 4, 50, 50), (5, 12, 2, 4, 9, 9), (6, 10, 3, 4, 2, 2)]
    scores = spark.createDataFrame(rows, "t_cut int, q_bins int, rank int, bins int, balance int, score long")
    assert tuple(s.best_pair(scores).first()) == (5, 12, 9)
    assert tuple(s.best_pair(scores.filter("rank <> 2 and rank <> 3")).first()) == (5, 10, 50)
    assert s.best_pair(scores.filter("rank > 9")).count() == 0


def test_grid_cap(spark):
    ranges = spark.createDataFrame([(list(range(2, 12)), list(range(5, 15)))], "t_cuts array<int>, q_bins array<int>")
    near = s.parameter_grid(ranges, target=20, cap=10).collect()
    assert len(near) == 10 and max(abs(r["t_cut"] + r["q_bins"] - 20) for r in near) <= 1
    sample = {tuple(r) for r in s.parameter_grid(ranges, cap=50).collect()}
    assert len(sample) == 50 and sample == {tuple(r) for r in s.parameter_grid(ranges, cap=50).collect()}
    assert sample != {tuple(r) for r in s.parameter_grid(ranges, cap=50, seed=1).collect()}
    middle = s.fallback_pair(ranges).first()
    assert tuple(middle) == (7, 10)
    empty = spark.createDataFrame([([], [])], "t_cuts array<int>, q_bins array<int>")
    assert tuple(s.fallback_pair(empty).first()) == (5, 15)


@pytest.mark.parametrize("counts,cutoff", [
    ({}, 1),                                        # no value from 1 on
    ({1: 500, 2: 300, 3: 100, 4: 2}, 3),            # candidates 2, 3, 4, 4: median 3.5
    ({1: 15, 2: 15}, 3),                            # no candidate: end of the leading run
    ({1: 15, 2: 15, 3: 14, 9: 14}, 4),              # gap
])
def test_small_value_cutoff(spark, counts, cutoff):
    rows = [(float(v),) for v, n in counts.items() for _ in range(n)]
    rows += [(0.0,)] * (1000 - len(rows))
    hist = Histogram(spark.createDataFrame(rows, "d double"), "d")
    assert s.small_value_cutoff(hist).first()["cutoff"] == cutoff


def test_plans(columns):
    fixed = plans.two_phase(columns["gap"], "d")
    assert fixed.facts["t_cut"] == 5 and len(fixed.binning.ranges) == 19
    assert fixed.report().first()["quantile_bins"] == 19
    found = plans.automatic(columns["gap"], "d")
    assert (found.facts["t_cut"], found.facts["q_bins"]) == (5, 15)
    binary = plans.chosen(columns["over45"], "d")
    assert binary.facts["strategy"] == s.BINARY
    assert {r["bin"] for r in binary.events.select("bin").distinct().collect()} == {0, 1}
    kept = plans.chosen(columns["over35"], "d")
    assert (kept.facts["t_cut"], kept.facts["q_bins"], kept.binning.ranges) == (16, 8, [])
    assert plans.bin_durations(columns["over35"], "d").select("bin").distinct().count() == 16
