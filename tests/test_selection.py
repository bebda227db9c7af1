"""Order statistics of long value tables, selected by buckets and not by a sort."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselog.operators import binning, search
from caselog.operators import histogram as h
from caselog.operators.sequence import Input, input_agreement, input_shapes


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "d double").repartition(3)


def skewed(seed, n):
    rng = random.Random(seed)
    return [rng.choice([rng.randint(0, 9), rng.expovariate(0.01), 10 ** rng.uniform(-3, 9), rng.randint(0, 400)]) for _ in range(n)]


@pytest.mark.parametrize("buckets", [3, 4096])
def test_quantiles_against_numpy(spark, monkeypatch, buckets):
    monkeypatch.setattr(h, "BUCKETS", buckets)
    values = skewed(1, 3000) + [None] * 20
    hist = h.Histogram(frame(spark, values), "d", 40)
    assert hist.long
    shares = [float(x) for x in np.linspace(0, 1, 21)]
    known = [v for v in values if v is not None]
    assert hist.quantiles({"d": shares})["d"] == pytest.approx(np.quantile(known, shares).tolist(), rel=1e-12)
    places = hist.places_at({"d": list(range(0, 3000, 7))})["d"]
    ordered = sorted(map(float, known))
    for rank, place in places.items():
        assert place.value == ordered[rank] and place.before <= rank < place.upto
        assert place.before == np.searchsorted(ordered, place.value) and place.upto == np.searchsorted(ordered, place.value, "right")


def test_columns_of_all_kinds_together(spark):
    df = spark.range(2000).select((F.col("id") * 3).cast("double").alias("a"), F.lit(4.0).alias("b"), (F.col("id") % 9).alias("c"))
    hist = h.Histogram(df, ["a", "b", "c"], 100)
    found = hist.quantiles({"a": [0.5], "b": [0.0, 1.0], "c": [0.25, 0.75]})
    assert found == {"a": [2998.5], "b": [4.0, 4.0], "c": [2.0, 6.0]}


def test_infinite_values_take_the_ordered_way(spark):
    hist = h.Histogram(frame(spark, [*range(200), float("inf"), float("-inf")]), "d", 20)
    assert hist.long and hist.quantiles({"d": [0.5]})["d"] == [99.5]


def test_binning_is_the_same_either_way(spark):
    df = frame(spark, [int(v) for v in skewed(2, 4000)])
    short, long = h.Histogram(df, "d"), h.Histogram(df, "d", 30)
    assert long.long and not short.long
    for t_cut, q_bins in ((5, 19), (1, 7), (50, 3), (10 ** 10, 4)):
        assert binning.fit_two_phase(short, t_cut, q_bins) == binning.fit_two_phase(long, t_cut, q_bins)
    assert binning.fit_cutoff(short, 30, 11) == binning.fit_cutoff(long, 30, 11)
    pairs = [(t, q, 10 * t + q) for t in (2, 5, 9) for q in (3, 8, 20)]
    rows = [sorted(map(tuple, search.pair_scores(x, pairs).collect())) for x in (short, long)]
    assert rows[0] == rows[1]
    assert sorted(search.t_cut_candidates(short).collect()) == sorted(search.t_cut_candidates(long).collect())


def test_many_distinct_values_are_not_sorted(spark):
    df = spark.range(600_000).select((F.col("id") * 7919 % 600_011).cast("double").alias("d"))
    hist = h.Histogram(df, "d")
    assert hist.long
    ordered = np.sort((np.arange(600_000, dtype=np.int64) * 7919 % 600_011).astype(float))
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    assert hist.quantiles({"d": shares})["d"] == pytest.approx(np.quantile(ordered, shares).tolist())
    assert hist._cumulative is None


def lengths(spark, rows):
    return Input(spark.createDataFrame(rows, "case int, len long"), 2)


def test_inputs_that_differ(spark):
    whole = [(c, 3 + c % 4) for c in range(20)]
    same, missing = lengths(spark, whole), lengths(spark, whole[1:])
    # As many cases and steps, but two lengths are exchanged.
    swapped = lengths(spark, [(0, 4), (1, 3), *whole[2:]])
    for inputs, regular in (({"a": same, "b": same}, True), ({"a": same, "b": missing}, False), ({"a": same, "b": swapped}, False)):
        assert {r.regular for r in input_shapes(inputs).collect()} == {regular}
    found = {r.input: (r.cases, r.missing, r.shorter) for r in input_agreement({"a": same, "b": missing, "c": swapped}).collect()}
    assert found == {"a": (20, 0, 1), "b": (19, 1, 0), "c": (20, 0, 1)}
