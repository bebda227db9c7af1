"""Both ways of computing running values, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from caselog.operators.ordered import LastFlagged, Ordered, Position, Previous, Total


def expected(rows):
    out, seen = {}, {}
    for key, at, value, flag in sorted(rows):
        count, total, previous, last = seen.get(key, (0, 0, None, None))
        if flag:
            last = count + 1
        out[(key, at)] = (count, total + value, previous, last)
        seen[key] = (count + 1, total + value, value, last)
    return out


@pytest.fixture(scope="module")
def skewed():
    """One key holds more than a third of the rows."""
    rng = random.Random(7)
    keys = ["hot"] * 400 + [f"k{i % 60}" for i in range(600)]
    return [(k, i, rng.randrange(10), rng.random() < 0.2) for i, k in enumerate(keys)]


@pytest.mark.parametrize("limit", [10_000, 5])
def test_running_values(spark, skewed, limit):
    rows = list(skewed)
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, v int, f boolean").repartition(5)
    run = Ordered(df, ["k"], ["at"], 400, limit)
    run.add(position=Position(), total=Total(F.col("v")), previous=Previous("v"), last=LastFlagged("f"))
    got = {(r["k"], r["at"]): (r["position"], r["total"], r["previous"], r["last"]) for r in run.result().collect()}
    assert got == expected(rows)
    assert run.split == (limit == 5)


def test_long_key_spreads_over_partitions(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, at int, v int, f boolean")
    run = Ordered(df, ["k"], ["at"], 400, 5)
    parts = run.long.filter(F.col("k") == "hot").select("__part").distinct().count()
    assert parts > 1


def test_short_keys_of_a_skewed_log_are_not_sorted_globally(spark, skewed):
    """Keys of up to 10 rows stay with plain windows; only the long one is sorted and written."""
    df = spark.createDataFrame(skewed, "k string, at int, v int, f boolean")
    run = Ordered(df, ["k"], ["at"], 400, 10)
    assert {r["k"] for r in run.long.select("k").distinct().collect()} == {"hot"}
    assert run.short.select("k").distinct().count() == 60 and "__row" not in run.short.columns
    done = run.add(position=Position()).result()
    assert done.filter("k <> 'hot'").groupBy("k").agg(F.max("position").alias("n")).filter("n <> 9").count() == 0
    assert sorted(r["position"] for r in done.filter("k = 'hot'").collect()) == list(range(400))


@pytest.mark.parametrize("limit", [10_000, 5])
def test_without_key_and_with_nulls(spark, limit):
    rows = [(i, None if i % 3 else i) for i in range(100)]
    df = spark.createDataFrame(rows, "at int, v int").repartition(4)
    run = Ordered(df, [], ["at"], 100, limit).add(position=Position(), previous=Previous("v"), total=Total(F.col("v")))
    got = sorted((r["at"], r["position"], r["previous"], r["total"]) for r in run.result().collect())
    total = 0
    for (at, position, previous, so_far), (_, value) in zip(got, rows):
        total += value or 0
        assert position == at
        assert previous == (rows[at - 1][1] if at else None)
        assert so_far == total


@pytest.mark.parametrize("limit", [10_000, 5])
def test_two_rounds(spark, limit):
    rows = [("a", i, i // 4) for i in range(40)] + [("b", i, 1) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, at int, day int").repartition(4)
    run = Ordered(df, ["k"], ["at"], 40, limit).add(before=Previous("day"))
    run.with_column("new", ~F.coalesce(F.col("before") == F.col("day"), F.lit(False)))
    run.add(island=Total(F.col("new").cast("long")))
    got = {(r["k"], r["at"]): r["island"] for r in run.result().collect()}
    assert got == {(k, at): (day + 1 if k == "a" else 1) for k, at, day in rows}
