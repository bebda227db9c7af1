"""Distribution analysis, parameter search and strategy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.catalog.registry import long, query, r6
from caselog.catalog.sql import EV, LI, two_phase as two_phase_sql, with_
from caselog.operators import search as s
from caselog.operators.binning import bin_counts
from caselog.operators.histogram import Histogram
from caselog.plans import duration as plans
from caselog.sources.views import event_log, line_log

LINE_KEYS = ["case_id", "l_linenumber", "l_partkey", "l_suppkey"]
THRESHOLD = 0.6


def minutes(spark, folder):
    return event_log(spark, folder).select("event_id", "duration_min")


def quantities(spark, folder, name):
    return line_log(spark, folder).select(*LINE_KEYS, name)


def histogram(spark, folder, name):
    source = event_log(spark, folder) if name == "duration_min" else line_log(spark, folder)
    return Histogram(source, name)


# -- SQL pieces: value counts, candidates, grid, scores, strategy ----------------------------


def counts(view, column):
    return f"""h AS (SELECT {column} AS v, count(*) AS n FROM {view} WHERE {column} IS NOT NULL GROUP BY 1),
c AS (
  SELECT v, n, CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) AS upto, lag(n) OVER (ORDER BY v) AS prev,
    row_number() OVER (ORDER BY v) AS place, CAST((SELECT count(*) FROM {view}) AS DOUBLE) AS total,
    count(*) OVER () AS distinct_values
  FROM h)"""


CANDIDATES = """tc AS (
  SELECT DISTINCT CAST(trunc(t) AS INTEGER) AS t FROM (
    SELECT v + 1 AS t FROM (
      SELECT p, min(v) AS v FROM c, (SELECT unnest([5, 10, 15, 20, 25]) AS p) WHERE upto / total * 100 >= p GROUP BY p)
    WHERE v <= 20
    UNION ALL SELECT max(v) + 1 FROM c WHERE n >= total * 0.01
    UNION ALL SELECT v FROM c WHERE place <= 20 AND prev > n * 3 AND n < total * CAST(0.005 AS DOUBLE))
  WHERE t >= 2 AND t < 26),
goal AS (
  SELECT CAST(least(CASE WHEN total < 1000 THEN 10 WHEN total < 10000 THEN 20 WHEN total < 100000 THEN 30 ELSE 50 END,
    distinct_values) AS INTEGER) AS target FROM c LIMIT 1),
qc AS (
  SELECT DISTINCT greatest(5, target - t) + d AS q FROM tc, goal, (SELECT unnest([-2, 0, 2]) AS d)
  WHERE greatest(5, target - t) + d BETWEEN 5 AND 50),
ts AS (SELECT t FROM tc UNION ALL SELECT unnest([3, 5, 7, 10]) WHERE NOT EXISTS (SELECT 1 FROM tc)),
qs AS (SELECT q FROM qc UNION ALL SELECT unnest([10, 15, 20, 25]) WHERE NOT EXISTS (SELECT 1 FROM qc))"""


def grid(choice):
    return f"""grid AS (
  SELECT t, q, rank FROM (
    SELECT t, q, CASE WHEN count(*) OVER () > 50 THEN row_number() OVER (ORDER BY choice, t, q)
      ELSE row_number() OVER (ORDER BY t, q) END AS rank
    FROM (SELECT t, q, {choice} AS choice FROM ts, qs))
  WHERE rank <= 50)"""


SAMPLED = grid("md5('42:' || CAST(t AS VARCHAR) || ':' || CAST(q AS VARCHAR))")


def nearest(target):
    return grid(f"abs(t + q - {target})")


def scores(view, column):
    return f"""longs AS (
  SELECT t, list({column} ORDER BY {column}) AS vs, count(*) AS n FROM {view}, (SELECT DISTINCT t FROM grid)
  WHERE {column} >= t GROUP BY t),
marks AS (
  SELECT DISTINCT rank, g.t, g.q, vs[(i * n) // g.q + 1] AS d, vs[n] AS top
  FROM grid g JOIN longs USING (t), range(0, 100) r(i) WHERE i < g.q),
spans AS (
  SELECT rank, d, coalesce(lead(d) OVER (PARTITION BY rank ORDER BY d), top + 1) AS stop FROM marks WHERE d < top),
sizes AS (
  SELECT rank, trunc(d) AS bin, sum(n) AS rows FROM spans, h WHERE v >= d AND v < stop GROUP BY rank, trunc(d)),
scored AS (
  SELECT g.t AS t_cut, g.q AS q_bins, g.rank, coalesce(bins, 0) AS bins, coalesce(spread, 0) AS balance,
    coalesce(spread, 0) + CASE WHEN coalesce(bins, 0) < 3 THEN 1000 WHEN bins > 50 THEN 100 ELSE 0 END AS score
  FROM grid g LEFT JOIN (
    SELECT rank, count(*) AS bins, max(rows) - min(rows) AS spread FROM sizes GROUP BY rank) USING (rank)),
best AS (
  SELECT t_cut, q_bins, score FROM scored
  ORDER BY score > 10, CASE WHEN score <= 10 THEN 0 ELSE score END, rank LIMIT 1)"""


CUTOFF = """w AS (
  SELECT CAST(v AS INTEGER) AS value, n, total, prev_n, next_v, covered FROM (
    SELECT v, n, total, lag(n) OVER (ORDER BY v) AS prev_n, lead(v) OVER (ORDER BY v) AS next_v,
      CAST(sum(n) OVER (ORDER BY v) AS DOUBLE) / total * 100 AS covered
    FROM c WHERE v >= 1 AND v = floor(v) AND v < (SELECT least(50, trunc(max(v)) + 1) FROM c))),
cand AS (
  SELECT value AS x FROM w WHERE n < prev_n * 0.5 AND prev_n > total * 0.01
  UNION ALL (SELECT value FROM w WHERE n / total * 100 < 1 ORDER BY value LIMIT 1)
  UNION ALL (SELECT value + 1 FROM w WHERE covered > 20 AND value <= 10 ORDER BY value LIMIT 1)
  UNION ALL SELECT value + 1 FROM w WHERE next_v - value > 2 AND value <= 15),
cut AS (
  SELECT CAST(CASE WHEN (SELECT count(*) FROM w) = 0 THEN 1
    WHEN (SELECT count(*) FROM cand) > 0
      THEN greatest(2, least(20, trunc((SELECT median(CAST(x AS DOUBLE)) FROM cand))))
    ELSE coalesce((SELECT max(value) + 1 FROM w WHERE value < coalesce(
      (SELECT min(value) FROM w WHERE n / total * 100 < 1), 50)), 2) END AS INTEGER) AS cutoff)"""

PATTERN = CUTOFF + f""",
shares AS (
  SELECT (SELECT coalesce(sum(n), 0) FROM c WHERE v = 0) AS zero_rows,
    (SELECT count(*) FROM c WHERE v > 0) AS positive_values,
    (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM w, cut WHERE value < cutoff) / (SELECT max(total) FROM c) AS small,
    (SELECT CAST(coalesce(sum(n), 0) AS DOUBLE) FROM c WHERE v = 0) / (SELECT max(total) FROM c) AS zero,
    (SELECT cutoff FROM cut) AS cutoff),
pattern AS (
  SELECT *, CASE WHEN zero > 0.85 THEN 'binary_zero_nonzero'
    WHEN zero > {THRESHOLD} AND small > 0.10 THEN 'two_phase_preserve_small'
    WHEN zero > {THRESHOLD} THEN 'binary_zero_nonzero' ELSE 'two_phase_standard' END AS strategy
  FROM shares)"""


def of(name):
    """View SQL, view name and column of a searched column."""
    return (EV, "ev", "duration_min") if name == "duration_min" else (LI, "li", name)


# -- distribution ------------------------------------------------------------------------------


@query("dist_small_values", with_(LI, counts("li", "qty")) + """
SELECT v AS value, n, CAST(upto AS BIGINT) AS upto, round(upto / total * 100, 6) AS percent,
  CAST(total AS BIGINT) AS total, distinct_values,
  (SELECT min(v) FROM c) AS lowest, (SELECT max(v) FROM c) AS highest
FROM c WHERE place <= 20 AND (upto - n) / total * 100 <= 80""")
def dist_small_values(spark, folder):
    return s.small_values(histogram(spark, folder, "qty")).withColumn("percent", F.round("percent", 6))


@query("dist_small_values_stop", with_(LI, counts("li", "over35")) + """
SELECT v AS value, n, CAST(upto AS BIGINT) AS upto, round(upto / total * 100, 6) AS percent
FROM c WHERE place <= 20 AND (upto - n) / total * 100 <= 80""")
def dist_small_values_stop(spark, folder):
    rows = s.small_values(histogram(spark, folder, "over35")).withColumn("percent", F.round("percent", 6))
    return rows.select("value", "n", "upto", "percent")


def _register_suggestions(name):
    view_sql, view, column = of(name)

    @query(f"suggest_t_cut_{name}", with_(view_sql, counts(view, column), CANDIDATES) + "SELECT t AS t_cut FROM ts")
    def t_cuts(spark, folder):
        ranges = s.suggestions(histogram(spark, folder, name))
        return ranges.select(F.explode("t_cuts").alias("t_cut"))

    @query(f"suggest_q_bins_{name}", with_(view_sql, counts(view, column), CANDIDATES) + "SELECT q AS q_bins FROM qs")
    def q_bins(spark, folder):
        ranges = s.suggestions(histogram(spark, folder, name))
        return ranges.select(F.explode("q_bins").alias("q_bins"))

    @query(f"suggest_target_{name}", with_(view_sql, counts(view, column), CANDIDATES) + "SELECT target FROM goal")
    def target(spark, folder):
        return s.suggestions(histogram(spark, folder, name)).select("target")


for _name in ("qty", "over35", "duration_min"):
    _register_suggestions(_name)


@query("suggest_with_target", with_(LI, counts("li", "qty"), CANDIDATES.replace(
    "least(CASE WHEN total < 1000 THEN 10 WHEN total < 10000 THEN 20 WHEN total < 100000 THEN 30 ELSE 50 END,\n"
    "    distinct_values)", "40")) + "SELECT q AS q_bins, target FROM qs, goal")
def suggest_with_target(spark, folder):
    ranges = s.suggestions(histogram(spark, folder, "qty"), 40)
    return ranges.select(F.explode("q_bins").alias("q_bins"), "target")


# -- grid and search -----------------------------------------------------------------------------


@query("param_grid", with_(LI, counts("li", "qty"), CANDIDATES, SAMPLED) + """
SELECT t AS t_cut, q AS q_bins, rank FROM grid""")
def param_grid(spark, folder):
    grid_rows = s.parameter_grid(s.suggestions(histogram(spark, folder, "qty")))
    return grid_rows.select("t_cut", "q_bins", long(F.col("rank"), "rank"))


@query("param_grid_target", with_(LI, counts("li", "qty"), CANDIDATES.replace(
    "least(CASE WHEN total < 1000 THEN 10 WHEN total < 10000 THEN 20 WHEN total < 100000 THEN 30 ELSE 50 END,\n"
    "    distinct_values)", "30"), nearest(30)) + "SELECT t AS t_cut, q AS q_bins, rank FROM grid")
def param_grid_target(spark, folder):
    grid_rows = s.parameter_grid(s.suggestions(histogram(spark, folder, "qty"), 30), 30)
    return grid_rows.select("t_cut", "q_bins", long(F.col("rank"), "rank"))


def _register_search(name):
    view_sql, view, column = of(name)
    base = with_(view_sql, counts(view, column), CANDIDATES, SAMPLED, scores(view, column))

    @query(f"pair_scores_{name}", base + """
SELECT t_cut, q_bins, rank, bins, CAST(balance AS BIGINT) AS balance, CAST(score AS BIGINT) AS score FROM scored""")
    def pair_scores(spark, folder):
        hist = histogram(spark, folder, name)
        pairs = [tuple(r) for r in s.parameter_grid(s.suggestions(hist)).collect()]
        scored = s.pair_scores(hist, pairs)
        return scored.select("t_cut", "q_bins", long(F.col("rank"), "rank"), long(F.col("bins"), "bins"),
                             long(F.col("balance"), "balance"), "score")

    @query(f"best_params_{name}", base + """
SELECT t_cut, q_bins, CAST(score AS BIGINT) AS score FROM best""")
    def best_params(spark, folder):
        hist = histogram(spark, folder, name)
        pairs = [tuple(r) for r in s.parameter_grid(s.suggestions(hist)).collect()]
        return s.best_pair(s.pair_scores(hist, pairs))


for _name in ("qty", "duration_min"):
    _register_search(_name)


@query("best_params_fallback", with_(LI, counts("li", "qty"), CANDIDATES) + """
SELECT ta[len(ta) // 2 + 1] AS t_cut, qa[len(qa) // 2 + 1] AS q_bins FROM (
  SELECT (SELECT list(t ORDER BY t) FROM ts) AS ta, (SELECT list(q ORDER BY q) FROM qs) AS qa)""")
def best_params_fallback(spark, folder):
    return s.fallback_pair(s.suggestions(histogram(spark, folder, "qty")))


# -- from end to end --------------------------------------------------------------------------------


@query("two_phase_default", with_(EV, two_phase_sql("ev", "duration_min", 5, 19)) + """
SELECT bin, count(*) AS n FROM binned GROUP BY bin""")
def two_phase_default(spark, folder):
    return bin_counts(plans.two_phase(minutes(spark, folder), "duration_min").events)


def searched(view_sql, view, column):
    return with_(view_sql, counts(view, column), CANDIDATES, SAMPLED, scores(view, column),
                 two_phase_sql(view, column, "(SELECT t_cut FROM best)", "(SELECT q_bins FROM best)"))


@query("two_phase_searched", searched(*of("duration_min")) + """
SELECT event_id, bin, (SELECT max(bin) + 1 FROM binned WHERE bin < (SELECT max(bin) FROM binned)) AS reported_cut
FROM binned""")
def two_phase_searched(spark, folder):
    result = plans.two_phase(minutes(spark, folder), "duration_min", None, None)
    cut = F.lit(float(result.facts["t_cut"]))
    return result.events.select("event_id", "bin", cut.alias("reported_cut"))


@query("auto_binning", searched(*of("duration_min")) + """,
per_bin AS (
  SELECT bin, count(DISTINCT duration_min) AS vals, min(duration_min) AS lowest FROM binned
  WHERE bin IS NOT NULL GROUP BY bin)
SELECT event_id, bin,
  (SELECT coalesce(max(bin) + 1, 5) FROM per_bin WHERE vals = 1 AND lowest = bin) AS detected_cut,
  (SELECT count(*) FROM per_bin WHERE NOT (vals = 1 AND lowest = bin)) AS detected_bins
FROM binned""")
def auto_binning(spark, folder):
    result = plans.automatic(minutes(spark, folder), "duration_min")
    return result.events.select(
        "event_id", "bin", F.lit(float(result.facts["t_cut"])).alias("detected_cut"),
        F.lit(result.facts["q_bins"]).cast("long").alias("detected_bins"))


@query("small_value_cutoff", with_(LI, counts("li", "qty"), CUTOFF) + "SELECT cutoff FROM cut")
def small_value_cutoff(spark, folder):
    return s.small_value_cutoff(histogram(spark, folder, "qty"))


def _register_pattern(name):
    view_sql, view, column = of(name)

    @query(f"zero_pattern_{name}", with_(view_sql, counts(view, column), PATTERN) + """
SELECT strategy, CAST(zero_rows AS BIGINT) AS zero_rows, positive_values, round(zero * 100, 6) AS zero_percent,
  cutoff, round(small * 100, 6) AS small_percent,
  CASE WHEN strategy = 'two_phase_preserve_small' THEN cutoff END AS t_cut,
  CASE WHEN strategy = 'two_phase_preserve_small'
    THEN CAST(greatest(8, least(25, positive_values // 3)) AS INTEGER) END AS q_bins
FROM pattern""")
    def zero_pattern(spark, folder):
        row = s.zero_pattern(histogram(spark, folder, name), THRESHOLD)
        return row.select("strategy", "zero_rows", "positive_values", r6("zero_percent", "zero_percent"), "cutoff",
                          r6("small_percent", "small_percent"), "t_cut", "q_bins")


for _name in ("qty", "over35", "over45", "duration_min"):
    _register_pattern(_name)


@query("smart_binning_binary", with_(LI, counts("li", "over45"), PATTERN) + f"""
SELECT {", ".join(LINE_KEYS)}, strategy, CASE WHEN over45 > 0 THEN 1 ELSE 0 END AS bin
FROM li, pattern WHERE strategy = 'binary_zero_nonzero'""")
def smart_binning_binary(spark, folder):
    result = plans.chosen(quantities(spark, folder, "over45"), "over45", THRESHOLD)
    return result.events.select(*LINE_KEYS, F.lit(result.facts["strategy"]).alias("strategy"), "bin")


@query("smart_binning_preserve", with_(LI, counts("li", "over35"), PATTERN, two_phase_sql(
    "li", "over35", "(SELECT cutoff FROM pattern)",
    "(SELECT greatest(8, least(25, positive_values // 3)) FROM pattern)")) + f"""
SELECT {", ".join(LINE_KEYS)}, strategy, bin
FROM binned, pattern WHERE strategy = 'two_phase_preserve_small'""")
def smart_binning_preserve(spark, folder):
    result = plans.chosen(quantities(spark, folder, "over35"), "over35", THRESHOLD)
    return result.events.select(*LINE_KEYS, F.lit(result.facts["strategy"]).alias("strategy"), "bin")


@query("smart_binning_standard", searched(*of("duration_min")) + f""",
{PATTERN}
SELECT event_id, strategy, bin FROM binned, pattern WHERE strategy = 'two_phase_standard'""")
def smart_binning_standard(spark, folder):
    result = plans.chosen(minutes(spark, folder), "duration_min", THRESHOLD)
    return result.events.select("event_id", F.lit(result.facts["strategy"]).alias("strategy"), "bin")


@query("enhanced_binning", with_(LI, counts("li", "qty"), CANDIDATES.replace(
    "least(CASE WHEN total < 1000 THEN 10 WHEN total < 10000 THEN 20 WHEN total < 100000 THEN 30 ELSE 50 END,\n"
    "    distinct_values)", "30"), nearest(30), scores("li", "qty"),
    two_phase_sql("li", "qty", "(SELECT t_cut FROM best)", "(SELECT q_bins FROM best)")) + f"""
SELECT {", ".join(LINE_KEYS)}, bin FROM binned""")
def enhanced_binning(spark, folder):
    rows = plans.bin_durations(quantities(spark, folder, "qty"), "qty", THRESHOLD, 30)
    return rows.select(*LINE_KEYS, "bin")
