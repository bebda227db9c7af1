"""Every registered query against its SQL on DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as contract
from caselog.catalog import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
FOLDER = os.environ.get("CASELOG_SF", "sf0.001")


@pytest.fixture(scope="module")
def duck(testdata):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{testdata}/{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def ordered(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple(map(repr, r)))


def test_contract(spark):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(QUERIES) <= set(queries) and set(ORACLES) <= set(oracles)
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark, testdata):
    assert contract.entry(spark).count() == 1000


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, testdata, duck, name):
    df = QUERIES[name](spark, f"{testdata}/{FOLDER}")
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name not in ORACLES:
        assert rows
        return
    result = duck.execute(ORACLES[name])
    found = [c[0] for c in result.description]
    assert sorted(found) == columns
    place = [found.index(c) for c in columns]
    expected = [tuple(r[i] for i in place) for r in result.fetchall()]
    assert ordered(map(tuple, rows)) == ordered(expected)
