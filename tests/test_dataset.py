import math

import pytest
from pyspark.sql import functions as F

from caselog.log import EventLog
from caselog.operators import dataset as d
from caselog.operators import evaluate as v
from caselog.operators import predict as p
from caselog.operators.sequence import step_vectors
from caselog.plans import outcome
from caselog.session import scratch_table, shared_folder
from caselog.sources.tables import read_table, write_table


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, "a" if i % 10 < 6 else "b" if i % 10 < 9 else "c") for i in range(503)]
    return spark.createDataFrame(rows, "case int, label string")


def test_stratified_split(cases):
    split = sorted(d.fit_stratified(cases, "case", "label").apply(cases).collect())
    test = math.ceil(503 * 0.2)
    assert sum(r["split"] == "test" for r in split) == test and len(split) == 503
    quotas = {r["label"]: (r["n"], r["train"]) for r in d.class_quotas(cases, "label").collect()}
    for label, (n, train) in quotas.items():
        assert sum(r["label"] == label and r["split"] == "train" for r in split) == train
        assert abs(train - n * (503 - test) / 503) < 1
    again = sorted(d.fit_stratified(cases.repartition(3), "case", "label").apply(cases).collect())
    assert split == again
    other = sorted(d.fit_stratified(cases, "case", "label", seed=1).apply(cases).collect())
    assert split != other


def test_stratified_split_needs_two_cases_per_class(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "case int, label string")
    with pytest.raises(ValueError):
        d.fit_stratified(df, "case", "label")


@pytest.mark.parametrize("limit", [1000, 3])
def test_tail_split(cases, limit):
    split = d.fit_tail(cases, "case", limit=limit).apply(cases).orderBy("case").collect()
    assert [r["split"] for r in split] == ["train"] * math.floor(503 * 0.8) + ["validation"] * 101
    assert d.fit_tail(cases.limit(1), "case").apply(cases.limit(1)).first()["split"] == "validation"


def test_assembly_keeps_common_cases(spark):
    a = spark.createDataFrame([(1, 0, [1.0]), (1, 1, [2.0]), (2, 0, [3.0])], "case int, step int, vec array<double>")
    b = a.filter("case = 1")
    cases = spark.createDataFrame([(1, [0.5]), (2, [0.1]), (9, [0.2])], "case int, features array<double>")
    joined = d.assembled({"a": a, "b": b}, cases)
    assert sorted((r["case"], r["step"], r["a"], r["b"]) for r in joined.steps.collect()) == [
        (1, 0, [1.0], [1.0]), (1, 1, [2.0], [2.0])]
    assert [tuple(r) for r in joined.cases.collect()] == [(1, [0.5])]


def test_inputs_of_one_log(spark):
    rows = [(1, 1, "a", 2.0), (1, 0, "b", 1.0), (2, 0, "a", 3.0)]
    df = spark.createDataFrame(rows, "c int, i int, a string, n double")
    cases = spark.createDataFrame([(1, [0.5]), (9, [0.2])], "case int, features array<double>")
    vecs = {"n": F.array("n"), "is_a": F.array((F.col("a") == "a").cast("double"))}
    joined = d.with_cases(step_vectors(df, LOG, vecs), cases)
    assert sorted((r["step"], r["n"], r["is_a"]) for r in joined.steps.collect()) == [(0, [1.0], [0.0]), (1, [2.0], [1.0])]
    assert [r["case"] for r in joined.cases.collect()] == [1]


@pytest.fixture(scope="module")
def predicted(spark):
    return spark.createDataFrame(list(zip("aaaabbbccc", "aaabbbabbb")), "truth string, pred string")


def test_confusion_and_report(predicted):
    matrix = v.confusion_matrix(predicted)
    cells = {(r["truth"], r["pred"]): r["n"] for r in matrix.collect()}
    assert len(cells) == 9 and sum(cells.values()) == 10
    assert (cells[("a", "a")], cells[("b", "a")], cells[("c", "b")], cells[("c", "c")]) == (3, 1, 3, 0)
    wide = {r["truth"]: (r["a"], r["b"], r["c"]) for r in v.confusion_wide(matrix, ["a", "b", "c"]).collect()}
    assert wide == {"a": (3, 1, 0), "b": (1, 2, 0), "c": (0, 3, 0)}
    rows = {r["label"]: tuple(r)[1:] for r in v.classification_report(predicted).collect()}
    assert rows == {
        "a": (0.75, 0.75, 0.75, 4), "b": (0.3333, 0.6667, 0.4444, 3), "c": (0, 0, 0, 3),
        "accuracy": (None, None, 0.5, 10), "macro avg": (0.3611, 0.4722, 0.3981, 10),
        "weighted avg": (0.4, 0.5, 0.4333, 10)}
    assert v.weighted_f1(predicted).first()[0] == pytest.approx(0.433333, abs=1e-6)
    assert v.accuracy(predicted).first()[0] == 0.5


def test_weighted_f1_agrees_with_mllib(predicted):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    def number(c):
        return F.array_position(F.array(*[F.lit(x) for x in "abc"]), F.col(c)).cast("double")

    df = predicted.select(number("truth").alias("label"), number("pred").alias("prediction"))
    other = MulticlassClassificationEvaluator(metricName="weightedFMeasure").evaluate(df)
    assert v.weighted_f1(predicted).first()[0] == pytest.approx(other)


def test_cross_entropy_and_epoch(spark):
    df = spark.createDataFrame([([0.7, 0.3], 0), ([0.0, 1.0], 0)], "p array<double>, k int")
    expected = (-math.log(0.7) - math.log(1e-7)) / 2
    assert v.cross_entropy(df, "p", "k").first()[0] == pytest.approx(expected)
    history = spark.createDataFrame([(1, 0.50), (2, 0.61), (3, 0.61), (4, 0.58)], "epoch_at int, metric double")
    assert tuple(v.best_epoch(history, "epoch_at", "metric").first()) == (2, 0.61)


LOG = EventLog("c", "a", ("i",))


def test_flat_cases(spark):
    rows = [(1, 0, [1.0, 0.0]), (1, 1, [3.0, 1.0]), (1, 2, [-1.0, -1.0]), (2, 0, [5.0, -1.0]), (3, 0, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "c int, i int, vec array<double>")
    flat = {r["case"]: (r["mean"], r["last"], r["len"]) for r in p.flat_cases(df, LOG).collect()}
    assert flat == {1: ([2.0, 0.5], [3.0, 1.0], 2), 2: ([5.0, -1.0], [5.0, -1.0], 1), 3: ([0.0, 0.0], [0.0, 0.0], 0)}
    cases = spark.createDataFrame([(k, [0.5]) for k in (1, 2, 3)], "case int, features array<double>")
    assert p.feature_vectors(p.flat_cases(df, LOG), cases).count() == 3


def test_missing_labels_are_labels(spark):
    df = spark.createDataFrame([("a", None), ("a", "a"), (None, "b"), (None, None)], "truth string, pred string")
    matrix = {(r["truth"], r["pred"]): r["n"] for r in v.confusion_matrix(df).collect()}
    assert len(matrix) == 9 and sum(matrix.values()) == 4
    assert matrix["a", None] == matrix[None, "b"] == matrix[None, None] == matrix["a", "a"] == 1
    assert v.accuracy(df).first()[0] == 0.5
    support = {r["label"]: r["support"] for r in v.classification_report(df).collect()}
    assert support["a"] == 2 and support[None] == 2 and support["accuracy"] == 4
    wide = v.confusion_wide(v.confusion_matrix(df))
    assert wide.columns == ["truth", "a", "b", "null"]


def test_many_classes_are_split(spark):
    """5,000 classes of three cases: one test case in five, and every class has at least its floor."""
    cases = spark.range(15_000).selectExpr("id as case", "concat('k', id % 5000) as label")
    split = d.fit_stratified(cases, "case", "label").apply(cases)
    assert split.filter("split = 'test'").count() == 3000 and split.filter("split is null").count() == 0
    per = split.filter("split = 'train'").groupBy("label").count().agg(F.min("count"), F.max("count")).first()
    assert tuple(per) == (2, 3)


def test_training_learns_a_visible_rule(spark):
    events = [(c, i, "up" if c % 2 else "down", float(i)) for c in range(60) for i in range(3)]
    log = spark.createDataFrame(events, "c int, i int, a string, n double")
    cases = spark.createDataFrame([(c, "odd" if c % 2 else "even", "x", 1.0) for c in range(60)],
                                  "c int, result string, plan string, age double")
    ready = outcome.prepare(log, cases, LOG, "result", ["a"], ["n"], ["plan"], ["age"])
    assert ready.cases.count() == 60 and ready.test.count() == 12
    done = outcome.train_and_evaluate(ready)
    assert v.accuracy(done.predictions).first()[0] == 1.0
    tuned = outcome.train_and_evaluate(ready, tuned=True, strengths=(0.01, 0.1), mixings=(0.0,), rounds=5)
    probabilities = tuned.predictions.first()["probability"]
    assert sum(probabilities) == pytest.approx(1) and len(probabilities) == 2


def test_tables_round_trip(spark):
    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "é", 1.5)], "k int, t string, x double")
    assert scratch_table(spark, "x").startswith(shared_folder(spark))
    for name, schema in [("t.csv", "k int, t string, x double"), ("t", None)]:
        path = scratch_table(spark, name)
        write_table(df, path)
        assert sorted(map(tuple, read_table(spark, path, schema).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        read_table(spark, "x.csv")
