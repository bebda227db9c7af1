import random

import pytest
from pyspark.sql import functions as F

from caselog.log import EventLog, case_profile
from caselog.operators import sequence as q

LOG = EventLog("c", "a", ("i",), "t")
ROWS = [(1, 0, "t1", 5.0), (1, 1, "t1", 6.0), (1, 2, "t2", 7.0), (2, 3, "t1", 8.0)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(ROWS, "c int, i int, t string, v double")


@pytest.fixture(scope="module")
def skewed(spark):
    """A case with more than a third of the events, start times with runs and nulls."""
    rng = random.Random(5)
    cases = ["hot"] * 300 + [f"c{i % 50}" for i in range(450)]
    rows = [(c, i, rng.choice([None, i // 7, i // 7]), float(rng.randrange(9))) for i, c in enumerate(cases)]
    shuffled = list(rows)
    rng.shuffle(shuffled)
    return rows, spark.createDataFrame(shuffled, "c string, i int, t int, v double").repartition(6)


def tensor(rows):
    out = {}
    for r in rows.orderBy("case", "step").collect():
        out.setdefault(r["case"], []).append(r["vec"])
    return out


def brute_stacked(rows, most, eos):
    cases = {}
    for c, i, t, v in sorted(rows):
        cases.setdefault(c, []).append((t, v))
    steps = {}
    for c, events in cases.items():
        steps[c], last = [], object()
        for t, v in events:
            if t is not None and t == last:
                steps[c][-1].append(v)
            else:
                steps[c].append([v])
            last = t if t is not None else object()
        steps[c] = [s + [-1.0] * (most - len(s)) for s in steps[c]] + ([[0.0] * most] if eos else [])
    longest = max(map(len, steps.values()))
    return {c: s + [[-1.0] * most] * (longest - len(s)) for c, s in steps.items()}


@pytest.mark.parametrize("limit", [1000, 1])
def test_golden(small, limit):
    vec = F.array("v")
    plain = tensor(q.padded_log(small, LOG, 1, vec, False, limit=limit))
    assert plain == {1: [[5], [6], [7]], 2: [[8], [-1], [-1]]}
    closed = tensor(q.padded_log(small, LOG, 1, vec, True, limit=limit))
    assert closed == {1: [[5], [6], [7], [0]], 2: [[8], [0], [-1], [-1]]}
    stacked = q.padded_stacked_log(small, LOG, 1, vec, False, limit=limit)
    assert tensor(stacked) == {1: [[5, 6], [7, -1]], 2: [[8, -1], [-1, -1]]}
    mask = {(r["case"], r["step"]): r["valid"] for r in q.step_mask({"a": stacked}).collect()}
    assert mask == {(1, 0): True, (1, 1): True, (2, 0): True, (2, 1): False}
    assert tuple(q.tensor_shape(stacked).first()) == (2, 2, 2, True)


@pytest.mark.parametrize("limit", [100_000, 20])
def test_padded_against_brute_force(skewed, limit):
    rows, df = skewed
    cases = {}
    for c, i, t, v in sorted(rows):
        cases.setdefault(c, []).append([v])
    longest = max(map(len, cases.values())) + 1
    expected = {c: s + [[0.0]] + [[-1.0]] * (longest - len(s) - 1) for c, s in cases.items()}
    assert tensor(q.padded_log(df, LOG, 1, F.array("v"), True, limit=limit)) == expected
    profile = case_profile(df, LOG)
    assert (profile.events, profile.cases, profile.longest) == (750, 51, 300)


@pytest.mark.parametrize("limit", [100_000, 20])
@pytest.mark.parametrize("eos", [True, False])
def test_stacked_against_brute_force(skewed, limit, eos):
    rows, df = skewed
    most = q.largest_cooccurrence(df, LOG).first()["max_cooccur"]
    got = tensor(q.padded_stacked_log(df, LOG, 1, F.array("v"), eos, limit))
    assert got == brute_stacked(rows, most, eos)


def test_padding_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(q, "PAD_BLOCK", 3)
    lengths = spark.createDataFrame([(1, 2), (2, 10), (3, 9)], "case int, len long")
    got = sorted((r["case"], r["step"]) for r in q.pad_steps(lengths, 1, 10).collect())
    assert got == [(1, s) for s in range(2, 10)] + [(3, 9)]


def test_rows_are_cut_into_chunks(skewed):
    rows, df = skewed
    chunks = q.case_rows(q.steps(df, LOG, F.array("v")), 64).filter("case = 'hot'").orderBy("chunk").collect()
    assert [len(r["steps"]) for r in chunks] == [64, 64, 64, 64, 44]
    assert [r["first_step"] for r in chunks] == [0, 64, 128, 192, 256]
    hot = [[v] for c, i, t, v in sorted(rows) if c == "hot"]
    assert [s for r in chunks for s in r["steps"]] == hot


def test_too_many_simultaneous_events_are_refused(small):
    with pytest.raises(ValueError):
        q.stacked_steps(small, LOG, 1, q.CHUNK_STEPS + 1, F.array("v"))


def test_mask_over_inputs(spark):
    a = spark.createDataFrame([(1, 0, [-1.0]), (1, 1, [-1.0])], "case int, step int, vec array<float>")
    words = spark.createDataFrame([(1, 0, [0, 0]), (1, 1, [0, 4])], "case int, step int, vec array<long>")
    mask = {r["step"]: r["valid"] for r in q.step_mask({"a": a, "w": words}, {"w": 0.0}).collect()}
    assert mask == {0: False, 1: True}


def test_same_result_for_any_partitioning(skewed, spark):
    _, df = skewed
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in ("1", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(tensor(q.padded_stacked_log(df.repartition(int(n)), LOG, 1, F.array("v"), True, 20)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_twenty_thousand_simultaneous_events(spark):
    """More events in one step than a dense step may hold."""
    log = EventLog("c", "a", ("t", "i"), "t")
    df = spark.range(20_100).selectExpr("1 as c", "'x' as a", "if(id < 20000, 0, 1) as t", "id as i")
    cells = df.selectExpr("i", "0L as slot", "1L as span", "cast(i as double) as value")
    rows = q.stacked_cells(df, log, cells, 3, "i")
    assert rows.filter("step = 0").count() == 20_000 and rows.filter("step = 1").count() == 100
    assert rows.filter("step = 0 and slot <> 3 * value").count() == 0
    with pytest.raises(ValueError):
        q.padded_stacked_log(df, log, 1, F.array("i"))


def test_shapes_by_rule(spark):
    a = spark.createDataFrame([(1, 3), (2, 5)], "case int, len long")
    rows = q.input_shapes({"x": q.Input(a, 4, True), "y": q.Input(a, 2, True)}, 3, 7).collect()
    assert [tuple(r) for r in rows] == [("x", 2, 6, 4, True, 3, 7), ("y", 2, 6, 2, True, 3, 7)]
    rows = q.input_shapes({"x": q.Input(a, 4, True), "y": q.Input(a, 2)}).collect()
    assert {r["regular"] for r in rows} == {False}


def test_padding_is_not_gathered(spark, capsys):
    """Only steps of events meet by (case, step): padding steps, most of all rows here, are one row each and stay."""
    from caselog.operators.encode import fit_cells

    rows = [("long", i // 2, i, "a" if i % 3 else "b", float(i)) for i in range(60)]
    rows += [(f"c{k}", 0, 0, "a", 1.0) for k in range(40)]
    df = spark.createDataFrame(rows, "case_id string, t long, n long, kind string, amount double")
    log = EventLog(case="case_id", activity="kind", order=("t", "n"), start="t")
    stacked = q.stacked_log(df, log, columns=["kind", "amount"])
    assert stacked.events.columns == ["case_id", "step", "place", "kind", "amount"]
    encoding = fit_cells(df, ["kind"], ["amount"], True, True)
    plain = q.padded_stacked_cells(stacked, log, encoding)
    marked = q.padded_stacked_cells(stacked, log, encoding, mark="blank")
    assert sorted(map(tuple, marked.drop("blank").collect())) == sorted(map(tuple, plain.collect()))
    blank, events = marked.filter("blank").drop("blank"), marked.filter("not blank").drop("blank")
    assert blank.count() == blank.select("case", "step").distinct().count() == 41 * 31 - 70
    assert events.join(blank, ["case", "step"]).count() == 0
    blank.explain()
    assert "Exchange" not in capsys.readouterr().out
