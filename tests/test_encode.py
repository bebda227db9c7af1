import random
import statistics

import pytest
from pyspark.sql import functions as F

from caselog.functions.columns import (
    argmax,
    bin_key,
    concat_present,
    missing_to_null,
    pair_tokens,
    whole_minutes,
    word_tokens,
)
from caselog.log import EventLog, case_table
from caselog.operators import encode as c
from caselog.operators.words import WordIndex, padded_text, text_steps, text_width

NO = "<NO_DESC>"


def vectors(df, vec):
    return [r["vec"] for r in df.withColumn("vec", vec).orderBy("i").collect()]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(0, "b", 10.0, 7.0, -1.0), (1, "a", -1.0, 7.0, -1.0), (2, NO, 20.0, -1.0, -1.0), (3, "b", 40.0, 7.0, -1.0)]
    return spark.createDataFrame(rows, "i int, x string, y double, same double, none double")


def test_onehot(table):
    plain = c.fit_onehot(table, ["x"])
    assert plain.categories == {"x": [NO, "a", "b"]}
    assert vectors(table, plain.vector()) == [[0, 0, 1], [0, 1, 0], [1, 0, 0], [0, 0, 1]]
    masked = c.fit_onehot(table, ["x"], NO)
    assert vectors(table, masked.vector())[2] == [-1, -1, -1]
    unknown = table.withColumn("x", F.lit("new"))
    assert vectors(unknown, plain.vector())[0] == [0, 0, 0]
    with pytest.raises(ValueError):
        c.fit_onehot(table, ["x"], limit=2)


def test_onehot_of_numbers_and_nulls(spark):
    df = spark.createDataFrame([(0, 10, "a"), (1, 9, None), (2, 9, "b")], "i int, n int, s string")
    onehot = c.fit_onehot(df, ["n", "s"])
    assert onehot.categories == {"n": [9, 10], "s": ["a", "b", None]}
    assert vectors(df, onehot.vector()) == [[0, 1, 1, 0, 0], [1, 0, 0, 0, 1], [1, 0, 0, 1, 0]]


@pytest.mark.parametrize("limit,broadcast", [(100, 100), (1, 0)])
def test_sparse_form_agrees(table, limit, broadcast):
    slots = c.category_slots(table, ["x"], limit)
    cells = c.onehot_cells(table, ["i"], ["x"], slots, NO, broadcast)
    got = sorted((r["i"], r["slot"], r["cell"]) for r in cells.collect())
    assert got == [(0, 2, 1), (1, 1, 1), (2, 0, -1), (3, 2, 1)]


def test_minmax(table):
    scale = c.fit_minmax(table, ["y", "same", "none"])
    got = vectors(table, scale.vector())
    assert [v[0] for v in got] == pytest.approx([0, -1, 1 / 3, 1])
    assert [v[1] for v in got] == [0, 0, -1, 0]
    assert [v[2] for v in got] == [-1] * 4


@pytest.mark.parametrize("limit", [100_000, 1])
def test_median(table, limit):
    scale = c.fit_median(table, ["y", "same", "none"], limit)
    assert scale.fill == {"y": 20, "same": 7, "none": None}
    got = vectors(table, scale.vector())
    assert [v[0] for v in got] == pytest.approx([0, 1 / 3, 1 / 3, 1])
    assert [v[1] for v in got] == [0] * 4 and [v[2] for v in got] == [None] * 4


def test_median_of_many_values(spark):
    rng = random.Random(9)
    values = [rng.gauss(0, 5) for _ in range(1001)] + [1.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    assert c.fit_median(df, ["v"], 50).fill["v"] == statistics.median(values)


def test_vectors_and_validity(table):
    both = c.fit_vectors(table, ["x"], ["y"], True, True)
    assert both.width == 4
    assert vectors(table, both.vector())[2][:3] == [-1, -1, -1]
    assert vectors(table, c.fit_vectors(table, [], ["y"], True, True).vector())[1] == [-1]
    assert vectors(table, c.fit_vectors(table, ["x"], [], True, True).vector())[2] == [-1, -1, -1]
    for categories, numbers, mask in [(["x"], ["none"], True), (["x"], ["y"], True), (["x"], ["none"], False)]:
        v = c.fit_vectors(table, categories, numbers, mask, mask)
        rows = table.withColumn("vec", v.vector()).withColumn("valid", v.is_valid()).collect()
        for r in rows:
            assert r["valid"] == any(x != -1 for x in r["vec"])


def test_labels(spark):
    df = spark.createDataFrame([(0, "no"), (1, "yes"), (2, "no")], "i int, result string")
    rows = c.encoded_labels(df, "result").orderBy("i").collect()
    assert [(r["label_id"], r["label_vec"]) for r in rows] == [(0, [1, 0]), (1, [0, 1]), (0, [1, 0])]


def test_row_functions(spark):
    df = spark.createDataFrame(
        [("p", None, NO, 61.0, -1.0, [0.2, 0.5, 0.5]), (None, "q", "r", 60.0, float("nan"), [1.0, 0.0, 0.0])],
        "a string, b string, c string, s double, n double, p array<double>")
    rows = df.select(concat_present(["a", "b", "c"]).alias("t"), whole_minutes("s").alias("m"),
                     missing_to_null("n").alias("n"), argmax("p").alias("k"),
                     bin_key(F.col("s") / 2).alias("key")).collect()
    assert [tuple(r) for r in rows] == [("p", 2.0, None, 1, "30.5"), ("q_r", 1.0, None, 0, "30")]
    one = spark.range(1)
    tokens = one.select(pair_tokens(F.lit("a|b c|d|e é_1|²")).alias("t")).first()["t"]
    assert tokens == ["a|b", "c|d", "é_1|²"]
    words = one.select(word_tokens(F.lit("It's A_b,c\tD\n--e")).alias("t")).first()["t"]
    assert words == ["it's", "a_b", "c", "d", "e"]


def test_case_table(spark):
    df = spark.createDataFrame([(1, 2, "b", 5), (1, 1, None, 4), (2, 1, None, None)], "c int, i int, x string, y int")
    rows = case_table(df, EventLog("c", "x", ("i",)), ["x", "y"]).orderBy("c").collect()
    assert [tuple(r) for r in rows] == [(1, "b", 4), (2, None, None)]


LOG = EventLog("c", "x", ("i",))


@pytest.mark.parametrize("limit,broadcast", [(1000, 1000), (1, 0)])
def test_words(spark, limit, broadcast):
    rows = [(1, 0, "Send_Mail now"), (1, 1, "now Call"), (2, 0, "send_mail now"), (2, 1, None)]
    df = spark.createDataFrame(rows, "c int, i int, x string")
    index = WordIndex(df, LOG, "x", limit, broadcast)
    assert index.size == 4
    assert sorted(map(tuple, index.table.collect())) == [("call", 1, 3), ("now", 3, 1), ("send_mail", 2, 2)]
    steps = sorted(map(tuple, text_steps(df, LOG, "x", index, limit=limit).collect()))
    assert steps == [(1, 0, 0, 2), (1, 0, 1, 1), (1, 1, 0, 1), (1, 1, 1, 3), (2, 0, 0, 2), (2, 0, 1, 1)]
    assert text_width(df, LOG, "x") == 2
    dense = padded_text(df, LOG, "x", index, True, limit).orderBy("case", "step").collect()
    assert [r["vec"] for r in dense] == [[2, 1], [1, 3], [0, 0], [2, 1], [0, 0], [0, 0]]


def test_first_seen_word_wins_ties(spark):
    df = spark.createDataFrame([(1, 0, "b a")], "c int, i int, x string")
    assert sorted(map(tuple, WordIndex(df, LOG, "x").table.collect())) == [("a", 1, 2), ("b", 1, 1)]


def test_slots_of_numbers_are_ordered_by_size(spark):
    df = spark.createDataFrame([(9, "b"), (10, "a"), (2, None), (None, "a")], "k int, t string")
    slots = sorted((r["slot"], r["name"], r["value"]) for r in c.category_slots(df, ["k", "t"]).collect())
    assert [s[1:] for s in slots] == [("k", "2"), ("k", "9"), ("k", "10"), ("k", None), ("t", "a"), ("t", "b"), ("t", None)]
    assert [str(x) for x in c.fit_onehot(df, ["k"]).categories["k"][:3]] == [s[2] for s in slots[:3]]


def test_missing_text_is_an_event_without_words(spark):
    log = EventLog("c", "a", ("i",))
    df = spark.createDataFrame([(1, 0, "a", "x y"), (1, 1, "a", None), (1, 2, "a", "")], "c int, i int, a string, t string")
    rows = padded_text(df, log, "t", WordIndex(df, log, "t"), eos=False).collect()
    assert sorted((r["step"], r["vec"]) for r in rows) == [(0, [1, 2]), (1, [0, 0]), (2, [0, 0])]


def spread(cells, width):
    """Dense vectors from (i, slot, span, value)."""
    out = {}
    for r in cells.collect():
        row = out.setdefault(r["i"], [0.0] * width)
        row[r["slot"]:r["slot"] + r["span"]] = [r["value"]] * r["span"]
    return out


@pytest.mark.parametrize("mask", [True, False])
def test_long_cells_equal_the_dense_vectors(spark, mask):
    rng = random.Random(3)
    rows = [(i, rng.choice([NO, *"abcdef"]), rng.choice([9, 10, 2, None]), rng.choice([-1.0, 0.0, 3.5, 7.0])) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, x string, k int, n double")
    vectors = c.fit_vectors(df, ["x", "k"], ["n"], mask, mask)
    dense = {r["i"]: r["vec"] for r in vectors.apply(df).collect()}
    assert spread(c.encoded_cells(df, ["i"], ["x", "k"], ["n"], mask, mask), vectors.width) == dense


def test_ten_thousand_categories(spark):
    df = spark.range(12_000).selectExpr("id as i", "concat('k', id % 10000) as x", "cast(id as double) as n")
    cells = c.encoded_cells(df, ["i"], ["x"], ["n"], True, True)
    assert cells.filter("slot < 10000 and value = 1 and span = 1").count() == 12_000
    assert cells.filter("slot < 10000").select("slot").distinct().count() == 10_000
    assert cells.filter("slot = 10000").count() == 12_000
