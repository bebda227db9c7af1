import math
import random
from collections import Counter

import pytest

from caselog.log import EventLog
from caselog.operators import embedding as e
from caselog.plans.features import embedding_layer, with_placeholder

LOG = EventLog("c", "a", ("i",))
ROWS = [("c1", 0, "A", "0"), ("c1", 1, "B", "5"), ("c1", 2, "A", "0"), ("c2", 3, "A", "0"), ("c2", 4, "C", "12"),
        ("c3", 5, "B", "5"), ("c3", 6, "A", "0"), ("c3", 7, "D d", "5"), ("c4", 8, "E", "")]
SCORES = [1, 0.949360, 1, 0.632368, 1, 1, 0.526670, 0, 0]


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame(ROWS, "c string, i int, a string, bin string")


def scores(df):
    return [r["score"] for r in df.orderBy("i").collect()]


def test_golden(events):
    assert scores(e.duration_embedding(events, LOG)) == pytest.approx(SCORES, abs=1e-6)


@pytest.mark.parametrize("rows", [0, 1_000_000])
def test_statistics(events, rows):
    tokens = e.TokenTable(e.duration_keyed(events, LOG), LOG, rows)
    assert tokens.cases == 4
    idf = {r["token"]: (r["df"], round(r["idf"], 6)) for r in tokens.idf().collect()}
    assert idf == {"A|0": (3, 1.223144), "B|5": (2, 1.510826), "C|12": (1, 1.916291), "d|5": (1, 1.916291)}
    weights = {(r["case"], r["token"]): round(r["tfidf"], 6) for r in tokens.weights().collect()}
    assert weights[("c1", "A|0")] == 0.850816 and weights[("c3", "A|0")] == 0.4481
    got = {(r["case"], r["token"]): round(r["score"], 6) for r in tokens.scores().collect()}
    assert got[("c3", "A|0")] == 0.52667


def test_exact_tokens(events):
    exact = scores(e.duration_embedding(events, LOG, exact_tokens=True))
    assert exact[7] == 1.0 and exact[8] == 1.0


def test_null_activity_and_bin(spark):
    rows = [("x", 0, None, "1"), ("x", 1, "A", None), ("y", 2, "A", "1"), (None, 3, "A", "1")]
    df = spark.createDataFrame(rows, "c string, i int, a string, bin string")
    assert scores(e.duration_embedding(df, LOG))[:3] == [0, 0, 1]


def test_token_in_every_case(spark):
    rows = [("x", 0, "A", "1"), ("x", 1, "B", "1"), ("y", 2, "A", "1")]
    df = spark.createDataFrame(rows, "c string, i int, a string, bin string")
    got = {(r["case"], r["token"]): r["score"] for r in e.TokenTable(e.duration_keyed(df, LOG), LOG).scores().collect()}
    assert got[("x", "A|1")] == 0 and got[("y", "A|1")] == 1 and got[("x", "B|1")] == 1


def brute(rows):
    documents = {}
    for case, _, activity, key in rows:
        documents.setdefault(case, Counter())[f"{activity}|{key}"] += 1
    n = len(documents)
    df = Counter(t for d in documents.values() for t in d)
    weights = {}
    for case, terms in documents.items():
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in terms.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        weights[case] = {t: x / length for t, x in w.items()}
    result = []
    for case, _, activity, key in rows:
        token = f"{activity}|{key}"
        column = [weights[c].get(token, 0) for c in documents]
        low, high = min(column), max(column)
        span = high - low if high - low >= e.NO_RANGE else 1
        result.append((weights[case][token] - low) / span)
    return result


def test_against_brute_force_with_hot_case(spark):
    rng = random.Random(4)
    cases = ["hot"] * 200 + [f"c{i % 40}" for i in range(400)]
    rows = [(c, i, rng.choice("ABC"), str(rng.randrange(12))) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "c string, i int, a string, bin string").repartition(7)
    assert scores(e.duration_embedding(df, LOG)) == pytest.approx(brute(rows), abs=1e-9)


def test_features_and_forms(spark):
    rows = [("x", 0, "A", "r1", "<NO_DESC>"), ("x", 1, "A", None, "q"), ("y", 2, "A", "<NO_DESC>", "<NO_DESC>")]
    df = spark.createDataFrame(rows, "c string, i int, a string, r string, s string")
    keyed = e.feature_keyed(df, LOG, ["r", "s"])
    assert [r["key"] for r in keyed.orderBy("i").collect()] == ["r1", "q", ""]
    keys = e.vocabulary_list(keyed)
    assert keys == ["", "q", "r1"]
    assert sorted(map(tuple, e.vocabulary(keyed, 1).collect())) == [("", 0), ("q", 1), ("r1", 2)]
    embedded = e.embedded(keyed, LOG)
    wide = e.wide(embedded, keys).orderBy("i").collect()
    assert [(r["key_"], r["key_q"], r["key_r1"]) for r in wide] == [(0, 0, 1), (0, 1, 0), (0, 0, 0)]
    slots = e.slotted(embedded, e.vocabulary(keyed)).orderBy("i").collect()
    assert [(r["slot"], r["score"]) for r in slots] == [(2, 1), (1, 1), (0, 0)]
    layer = embedding_layer(keyed, LOG, keys, eos=True).orderBy("case", "step").collect()
    assert [r["vec"] for r in layer] == [[0, 0, 1], [0, 1, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [-1, -1, -1]]
    assert with_placeholder(df).first()["dummyf"] == "<NO_DESC>"
    with pytest.raises(ValueError):
        e.vocabulary_list(keyed, 2)


def test_numeric_bins_become_whole_texts(spark):
    df = spark.createDataFrame([("x", 0, "A", 3.0), ("x", 1, "A", 2.5)], "c string, i int, a string, bin double")
    assert [r["key"] for r in e.duration_keyed(df, LOG).orderBy("i").collect()] == ["3", "2.5"]


def test_documents_in_parts(events):
    from caselog.operators.sequence import with_steps

    keyed = with_steps(e.duration_keyed(events, LOG), LOG)
    whole = {r["case"]: r["document"] for r in e.case_documents(keyed, LOG, 100).collect()}
    assert whole["c1"] == "A|0 B|5 A|0" and whole["c3"] == "B|5 A|0 D d|5"
    parts = {(r["case"], r["part"]): r["document"] for r in e.case_documents(keyed, LOG, 2).collect()}
    assert parts[("c1", 0)] == "A|0 B|5" and parts[("c1", 1)] == "A|0"
