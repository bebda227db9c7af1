"""Common table expressions shared by the SQL twins of the queries."""

from __future__ import annotations

import numpy as np

EV = """ev AS (
  SELECT user_id AS case_id, event_id, ts AS start_ts, CAST(ts AS DATE) AS start_day, event_type AS activity,
    CASE WHEN k % 7 = 0 THEN '<NO_DESC>' ELSE 'r' || CAST(k % 7 AS VARCHAR) END AS resource,
    CASE WHEN event_id % 11 = 0 THEN CAST(-1 AS DOUBLE) ELSE value END AS amount,
    value * CAST(600 AS DOUBLE) AS duration_s,
    ceil(value * CAST(600 AS DOUBLE) / CAST(60 AS DOUBLE)) AS duration_min
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

LI = """li AS (
  SELECT l_orderkey AS case_id, l_shipdate AS start_ts, l_linenumber, l_partkey, l_suppkey,
    l_returnflag, l_linestatus, l_discount, l_tax, l_quantity AS qty,
    greatest(CAST(0 AS DOUBLE), l_quantity - 35) AS over35,
    greatest(CAST(0 AS DOUBLE), l_quantity - 45) AS over45
  FROM lineitem)"""

TURNS = """turns AS (SELECT conv_id AS case_id, turn, role, text FROM conversations)"""

CASES = """cases AS (
  SELECT c_custkey AS case_id, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS result FROM customer)"""

PRED = """preds AS (
  SELECT o_orderkey AS case_id, o_orderstatus AS truth,
    CASE WHEN o_orderkey % 4 = 0 THEN 'F' WHEN o_orderkey % 4 = 1 THEN 'O' ELSE o_orderstatus END AS pred
  FROM orders)"""

# Words of a text, in order, with 1-based place.
BLANKS = '!"#$%&()*+,-./:;<=>?@[\\]^`{|}~'
WORDS = f"""words AS (
  SELECT case_id, turn, place - 1 AS place, word FROM (
    SELECT case_id, turn, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS place FROM (
      SELECT case_id, turn, list_filter(string_split(lower(translate(text,
        '{BLANKS}' || chr(9) || chr(10), repeat(' ', {len(BLANKS) + 2}))), ' '), lambda w : w <> '') AS ws
      FROM turns)))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def split_sql(source: str, name: str, seed: int, share: float = 0.2) -> str:
    """CTE `name` (case_id, part) of a stratified split of `source` (case_id, result)."""
    return f"""{name}_sizes AS (SELECT result, count(*) AS n FROM {source} GROUP BY result),
{name}_shares AS (
  SELECT result, n * (t - CAST(ceil(t * CAST({share!r} AS DOUBLE)) AS BIGINT)) / CAST(t AS DOUBLE) AS share,
    t - CAST(ceil(t * CAST({share!r} AS DOUBLE)) AS BIGINT) AS train_rows
  FROM {name}_sizes, (SELECT count(*) AS t FROM {source})),
{name}_quotas AS (
  SELECT result, CAST(floor(share) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, result)
    <= train_rows - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS train
  FROM {name}_shares),
{name} AS MATERIALIZED (
  SELECT case_id, CASE WHEN row_number() OVER (PARTITION BY result ORDER BY md5('{seed}:' || CAST(case_id AS VARCHAR))) <= train
    THEN 'train' ELSE 'test' END AS part
  FROM {source} JOIN {name}_quotas USING (result))"""


def quantile_shares(points: int) -> str:
    return ", ".join(f"CAST('{float(p)!r}' AS DOUBLE)" for p in np.linspace(0, 1, points))


def cutoff_edges(view: str, column: str, cut: int, points: int) -> str:
    """CTE `edges` (lower, upper) of the fixed-cut quantile bins."""
    shares = quantile_shares(points)
    return f"""whole AS (
  SELECT DISTINCT trunc(v) AS v FROM (
    SELECT unnest(quantile_cont({column}, [{shares}])) AS v FROM {view} WHERE {column} >= {cut})
  UNION SELECT max({column}) FROM {view} WHERE {column} >= {cut}),
marks AS (
  SELECT min(v) AS v FROM whole UNION SELECT v + 1 FROM whole WHERE v > (SELECT min(v) FROM whole)),
edges AS (
  SELECT * FROM (SELECT v AS lower, lead(v) OVER (ORDER BY v) AS upper FROM marks) WHERE upper IS NOT NULL)"""


def two_phase(view: str, column: str, t_cut, q_bins, name: str = "binned") -> str:
    """CTE `starts` of the quantile bins and `name`: the view's rows with `bin`.

    `t_cut` and `q_bins` may be scalar subqueries.
    """
    return f"""sorted_long AS (
  SELECT {column} AS d, row_number() OVER (ORDER BY {column}) - 1 AS place, count(*) OVER () AS n
  FROM {view} WHERE {column} >= {t_cut}),
starts AS (
  SELECT DISTINCT d FROM (
    SELECT s.d FROM sorted_long s, range(0, 100) t(i) WHERE i < {q_bins} AND s.place = (i * s.n) // {q_bins})
  WHERE d < (SELECT max(d) FROM sorted_long)),
{name} AS (
  SELECT v.*, CASE WHEN v.{column} < {t_cut} THEN v.{column} ELSE trunc(s.d) END AS bin
  FROM {view} v ASOF LEFT JOIN starts s ON v.{column} >= s.d)"""


def float6(expression: str) -> str:
    """A single-precision value as shown by the queries."""
    return f"round(CAST(CAST({expression} AS FLOAT) AS DOUBLE), 6)"
