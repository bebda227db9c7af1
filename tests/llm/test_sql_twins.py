"""Every query that SQL can express, on whole tables and on awkward ones."""

import duckdb
import pytest
from pyspark.sql import functions as F

from caselog.llm import line_spread, mixing
from caselog.llm.queries import ORACLES, QUERIES


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_twin(spark, testdata, name, size):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{testdata}/{size}/{t}.parquet'")
    found = QUERIES[name](spark, f"{testdata}/{size}")
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(found.columns)
    assert ordered(found.select(*names).collect()) == ordered(result.fetchall())


def test_lines_at_the_threshold(spark):
    """Nine sites keep a line, ten lose it, however often each shows it; hot lines and null sites."""
    rows = []
    for site in range(40):
        text = "everywhere\nkept here"
        text += "\n nine " if site < 9 else ""
        text += "\nten" if site < 10 else ""
        text += "\nmany on one site" * 30 if site == 0 else ""
        rows += [(len(rows) + k, f"{text}\nown {site} {k}", f"s{site}") for k in range(4)]
    rows += [(None, "ten\n\n nine", None), (900, None, "s1"), (901, "", None), (901, "", None), (902, "kept here", "s1")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, line string, n string")
    clean = line_spread.without_boilerplate(docs, F.col("source")).collect()
    assert len(clean) == len(rows)
    for r in clean:
        lines = (r.text or "").split("\n")
        assert "everywhere" not in lines and "ten" not in lines and "kept here" not in lines
    assert sum("nine" in (r.text or "") for r in clean) == 37
    assert [(r.text, r.n_lines, r.n_removed) for r in clean if r.doc_id is None] == [("\n nine", 2, 1)]
    assert [(r.text, r.n_lines, r.n_removed) for r in clean if r.doc_id == 900] == [(None, 0, 0)]
    assert [r.text for r in clean if r.doc_id in (901, 902)] == ["", "", ""]
    assert line_spread.without_boilerplate(docs.limit(0), F.col("source")).collect() == []


def test_boilerplate_of_awkward_documents(edge_docs):
    """Columns of the same names give way; very long texts are worked through whole."""
    clean = line_spread.without_boilerplate(edge_docs, F.col("source"), 2)
    assert sorted(clean.columns) == sorted(edge_docs.columns) and clean.count() == edge_docs.count()
    assert dict(clean.dtypes)["n_lines"] == "bigint"
    assert {r.n_lines for r in clean.filter("doc_id in (8, 9)").collect()} == {1}


def test_shortages_go_to_siblings_first(spark):
    """web/en/src0 is short: src4 takes over before de, and de before news."""
    rows = [(1, "a " * 10, "en", "src0"), (2, "a " * 500, "en", "src4"), (3, "a " * 500, "de", "src8"), (4, "a " * 500, "en", "src1")]
    leaves = mixing.budgets(
        spark.createDataFrame([("web", "en", "src0", 10, 1), ("web", "en", "src4", 500, 1), ("web", "de", "src8", 500, 1),
                               ("news", "en", "src1", 500, 1)], "domain string, lang string, source string, tokens long, n long"),
        {"domain": {"web": 1, "news": 1}, "lang": {"en": 1, "de": 1}}, 400, 1)
    found = {r.source: r.budget for r in leaves.collect()}
    assert found == {"src0": 10, "src4": 90, "src8": 100, "src1": 200}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    weights = {"domain": {"web": 1, "news": 1}, "lang": {"en": 1, "de": 1}}
    taken = {}
    for r in mixing.mixed(docs, weights, percent=100, epochs=1).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.tokens_taken
    assert taken == {1: 10, 2: 500, 3: 500, 4: 500}


def test_mixing_edges(edge_docs, no_docs):
    rows = mixing.mixed(edge_docs, percent=60, epochs=3).collect()
    total = sum(len((r.text or "").split()) for r in edge_docs.collect())
    assert abs(sum(r.tokens_taken for r in rows) - total * 60 // 100) <= 5
    assert all(0 <= r.tokens_taken <= r.n_tokens for r in rows)
    assert {r.lang for r in rows} <= {"en", "(none)"}
    assert mixing.mixed(no_docs).collect() == []
    assert mixing.mixture(no_docs).columns == no_docs.columns
    again = mixing.mixed(edge_docs.repartition(5), percent=60, epochs=3).collect()
    assert ordered(rows) == ordered(again)
    short = edge_docs.filter("doc_id in (4, 5, 6)")
    assert mixing.mixed(short).collect() == []
