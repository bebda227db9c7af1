import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselog.log import EventLog
from caselog.operators import cells as k
from caselog.operators import linear
from caselog.operators.encode import fit_cells, fit_vectors
from caselog.operators.lookup import Lookup, fit_lookup
from caselog.plans import outcome
from caselog.plans.features import Inputs, assembled_cells

LOG = EventLog("c", "a", ("i",))


# -- lookups ------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_lookup_of_a_word_in_half_of_all_rows(spark, limit):
    """Sent whole, or only its hot keys: the same rows, null keys included."""
    rows = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 97 == 1, None).otherwise(
        F.concat(F.lit("w"), (F.col("id") % 1500).cast("string"))).alias("word"))
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("slot", F.xxhash64("word"))
    counts = counts.filter("word is null or word <> 'w7'")
    table = fit_lookup(counts, ["word"], limit)
    assert table.rows == counts.count() and table.size > 0
    found = table.join(rows)
    assert sorted(found.columns) == ["id", "slot", "word"]
    expected = rows.filter("word is null or word <> 'w7'").withColumn("slot", F.xxhash64("word"))
    assert sorted(map(tuple, found.select("id", "word", "slot").collect()), key=repr) == sorted(
        map(tuple, expected.collect()), key=repr)


def test_hot_keys_are_not_shuffled(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("word"))
    counts = rows.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    plan = Lookup(counts, ["word"], 2001, 1 << 40).join(rows)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan


# -- long cells ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    rows = []
    for c in range(40):
        for i in range(rng.randint(1, 9)):
            rows.append((c, i, rng.choice(["x", "y", "<NO_DESC>"]), rng.choice(["p", "q", "<NO_DESC>", None]),
                         rng.choice([-1.0, None, 0.5, 2.0, 7.0])))
        if c % 6 == 0:  # no valid event
            rows = [r for r in rows if r[0] != c] + [(c, 0, "<NO_DESC>", "<NO_DESC>", -1.0)]
    return spark.createDataFrame(rows, "c int, i int, a string, b string, n double").repartition(3)


def test_flat_cells_equal_the_dense_vectors(spark, log):
    vectors = fit_vectors(log, ["a", "b"], ["n"], True, True)
    by_case = {}
    for r in log.withColumn("vec", vectors.vector()).collect():
        by_case.setdefault(r.c, []).append((r.i, r.vec))
    encoding = fit_cells(log, ["a", "b"], ["n"], True, True)
    assert encoding.width == vectors.width
    events = log.select(F.col("c").alias("case"), F.col("i").alias("step"), "a", "b", "n")
    valid = encoding.is_valid()
    flat = k.flat_cells(events, encoding.cells(events.withColumn("valid", valid), ["case", "step", "valid"]), valid)
    found = {(r.case, r.slot): (r["mean"], r["last"]) for r in flat.cells.collect()}
    lengths = {r.case: r.len for r in flat.cases.collect()}
    for c, steps in by_case.items():
        good = [v for _, v in sorted(steps) if any(x != -1 for x in v)]
        assert lengths[c] == len(good)
        for slot in range(vectors.width):
            mean = sum(v[slot] for v in good) / len(good) if good else 0.0
            last = good[-1][slot] if good else 0.0
            assert found.get((c, slot), (0.0, 0.0)) == pytest.approx((mean, last))


def test_ten_thousand_keys_and_five_thousand_classes(spark):
    """From encoding to the confusion matrix without anything dense over keys."""
    events = spark.range(15_000).selectExpr(
        "id as c", "0 as i", "concat('key', id % 10000) as a", "cast(id % 7 as double) as n", "id % 2 as one")
    cases = spark.range(15_000).selectExpr("id as c", "concat('k', id % 5000) as result", "'x' as plan", "1.0 as age")
    ready = outcome.prepare(events, cases, LOG, "result", ["a"], ["n"], ["plan"], ["age"])
    assert ready.classes == 5000 and ready.slots == 2 * 10_001 + 2 + 2
    assert ready.cases.count() == 15_000 and ready.test.count() == 3000
    # The classes are too many for a model in a small test; their ids go on to the matrix.
    named = ready.test.select(F.col("label").alias("truth"), F.col("label").alias("pred")).limit(300)
    from caselog.operators.evaluate import accuracy, pair_counts
    assert accuracy(named).first()[0] == 1.0 and pair_counts(named).count() <= 300


def test_assembled_inputs_of_ten_thousand_keys(spark):
    events = spark.range(12_000).selectExpr(
        "id % 4000 as c", "id as i", "'go' as a", "concat('r', id % 10000) as b", "cast(id % 10001 as double) as bin",
        "cast(id % 3 as double) as n", "concat('w', id % 50, ' w', id % 9) as words")
    cases = spark.range(5000).selectExpr("id as c", "if(id = 17, null, concat('k', id % 3)) as result", "'x' as plan")
    inputs = Inputs(["a"], ["n"], "bin", ["b"], "words", ["plan"])
    ready = assembled_cells(events, cases, LOG, "result", inputs)
    widths = ready.directory.widths
    assert list(widths) == ["event", "duration", "feature", "text", "case"]
    assert widths["duration"] == 10_001 and widths["feature"] == 10_000 and widths["text"] == 2
    assert ready.labels.count() == 3999 and ready.classes == 3
    per = {r["input"]: (r.low, r.high, r.cases) for r in ready.cells.groupBy("input").agg(
        F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("case").alias("cases")).collect()}
    assert set(per) == set(widths)
    for name, (low, high, number) in per.items():
        first = ready.directory.first(name)
        assert first <= low <= high < first + widths[name] and number <= 3999
    assert per["event"][2] == per["text"][2] == per["case"][2] == 3999


# -- models -----------------------------------------------------------------------------------


def brute(x, y, classes, settings, rounds):
    """The same rounds with dense matrices."""
    n, slots = x.shape
    scale = np.abs(x).max(axis=0)
    scale[scale == 0] = 1
    x = x / scale
    prior = np.log(np.maximum(np.bincount(y, minlength=classes), linear.LEAST_COUNT) / n)
    hit = np.eye(classes)[y]
    out = []
    for s in settings:
        w = np.zeros((slots, classes))
        w[-1] = prior
        penalty = np.full((slots, 1), s.strength)
        penalty[-1] = 0
        losses = []
        for _ in range(rounds + 1):
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            losses.append(-np.log(p[np.arange(n), y]).mean() + (penalty * ((1 - s.mixing) / 2 * w ** 2 + s.mixing * np.abs(w))).sum())
            if len(losses) > rounds:
                break
            pull, bend = x.T @ (hit - p) / n, np.abs(x).T @ (np.abs(x).sum(axis=1, keepdims=True) * p) / n
            bend = bend + penalty * (1 - s.mixing)
            aim = w + np.divide(pull - penalty * (1 - s.mixing) * w, bend, out=np.zeros_like(w), where=bend > 0)
            w = np.where(bend > 0, np.sign(aim) * np.maximum(np.abs(aim) - np.divide(penalty * s.mixing, bend, out=np.zeros_like(w), where=bend > 0), 0), w)
        out.append((w / scale[:, None], p, losses))
    return out


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((90, 7)) * (rng.random((90, 7)) < 0.6) * np.array([1, 5, 0.1, 1, 1, 30, 0])
    x = np.hstack([x, np.ones((90, 1))])
    y = (x[:, 0] + rng.standard_normal(90) > 0).astype(int) + (x[:, 1] > 1)
    rows = [(i, int(y[i]), [int(j) for j in np.flatnonzero(x[i])], [float(v) for v in x[i][x[i] != 0]]) for i in range(90)]
    return x, y, spark.createDataFrame(rows, "case int, label_id int, slots array<long>, values array<double>").repartition(3)


@pytest.mark.parametrize("small", [True, False])
def test_rounds_against_dense_matrices(sparse, monkeypatch, small):
    x, y, rows = sparse
    if not small:
        monkeypatch.setattr(linear, "BROADCAST_BYTES", 0)
    settings = linear.grid((0.01, 0.2), (0.0, 0.7))
    model = linear.fit(rows, 8, 3, settings, 3)
    assert model.small == small
    expected = brute(x, y, 3, settings, 3)
    weights = {(r.setting, r.slot, r.label_id): r.weight for r in model.weights().collect()}
    assert len(weights) == 4 * 8 * 3
    for s, (w, _, losses) in enumerate(expected):
        assert all(a >= b - 1e-12 for a, b in zip(losses, losses[1:], strict=False))  # never rises
        assert all(weights[s, j, c] == pytest.approx(w[j, c], abs=1e-9) for j in range(8) for c in range(3))
    found = {r.case: r.probability for r in linear.probabilities(rows, model.only(2)).collect()}
    assert all(found[i] == pytest.approx(expected[2][1][i].tolist(), abs=1e-9) for i in range(90))
    trials = {r.trial: r for r in linear.trials(rows, model).collect()}
    for s, (_, p, _) in enumerate(expected):
        assert trials[s + 1].accuracy == pytest.approx((p.argmax(axis=1) == y).mean())
        assert trials[s + 1].loss == pytest.approx(-np.log(p[np.arange(90), y]).mean())
    best = outcome.best_setting(linear.trials(rows, model), "accuracy")
    assert best in settings


def test_a_changed_label_changes_the_weights(sparse):
    _, _, rows = sparse
    other = rows.withColumn("label_id", F.when(F.col("case") == 0, (F.col("label_id") + 1) % 3).otherwise(F.col("label_id")))
    a, b = (sorted(map(tuple, linear.fit(r, 8, 3, [linear.Setting()], 2).weights().collect())) for r in (rows, other))
    assert a != b
