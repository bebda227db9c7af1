"""Binning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from caselog.catalog.registry import long, query, r6
from caselog.catalog.sql import EV, LI, cutoff_edges, quantile_shares, two_phase as two_phase_sql, with_
from caselog.operators import binning as b
from caselog.operators.histogram import Histogram
from caselog.plans.duration import BinaryBinning
from caselog.sources.views import event_log, line_log

CUT, POINTS = 5, 24
T_CUT, Q_BINS = 5, 19


def minutes(spark, folder):
    return event_log(spark, folder).select("case_id", "event_id", "duration_min")


def quantities(spark, folder, name="qty"):
    return line_log(spark, folder).select(name)


@query("bin_cutoff", with_(EV, cutoff_edges("ev", "duration_min", CUT, POINTS)) + f"""
SELECT event_id,
  CASE WHEN duration_min < {CUT} THEN CAST(CAST(trunc(duration_min) AS BIGINT) AS VARCHAR)
    ELSE CAST(CAST(lower AS BIGINT) AS VARCHAR) END AS bin,
  CASE WHEN duration_min < {CUT}
      THEN '[' || CAST(duration_min AS VARCHAR) || ', ' || CAST(duration_min + 1 AS VARCHAR) || ')'
    ELSE '[' || CAST(CAST(lower AS BIGINT) AS VARCHAR) || ', ' || CAST(CAST(upper AS BIGINT) AS VARCHAR) || ')'
  END AS bin_range
FROM ev LEFT JOIN edges ON duration_min >= lower AND duration_min < upper""")
def bin_cutoff(spark, folder):
    return b.cutoff_bins(minutes(spark, folder), "duration_min", CUT, POINTS).select("event_id", "bin", "bin_range")


def repeated(view, column, cut, points):
    """Whether two of the quantiles are equal."""
    shares = quantile_shares(points)
    return (f"(SELECT len(list_distinct(v)) < len(v) FROM (SELECT quantile_cont({column}, [{shares}]) AS v "
            f"FROM {view} WHERE {column} >= {cut}))")


@query("bin_guards", with_(EV, LI, "known AS (SELECT amount FROM ev WHERE amount <> -1)") + f"""
SELECT 'duration_min' AS col, 'ok' AS guard, count(DISTINCT CASE WHEN duration_min < 60 THEN duration_min END) AS short_values,
  count(DISTINCT CASE WHEN duration_min < 60 THEN duration_min END) > 50 AS many_short_bins,
  {repeated('ev', 'duration_min', 60, 24)} AS duplicate_quantiles FROM ev
UNION ALL SELECT 'missing', 'has_null', count(DISTINCT CASE WHEN amount < 60 AND amount <> -1 THEN amount END),
  count(DISTINCT CASE WHEN amount < 60 AND amount <> -1 THEN amount END) > 50, {repeated("known", "amount", 60, 24)} FROM ev
UNION ALL SELECT 'resource', 'not_numeric', 0, false, false
UNION ALL SELECT 'qty', 'ok', count(DISTINCT CASE WHEN qty < 10 THEN qty END), false,
  {repeated('li', 'qty', 10, 60)} FROM li
UNION ALL SELECT 'one', 'one_value', count(DISTINCT CASE WHEN qty - qty + 7 < 60 THEN 7 END), false, false FROM li
UNION ALL SELECT 'few', 'few_points', count(DISTINCT CASE WHEN qty < 60 THEN qty END), false, false FROM li""")
def bin_guards(spark, folder):
    events = event_log(spark, folder).withColumn("missing", F.nullif("amount", F.lit(-1.0)))
    lines = line_log(spark, folder).withColumn("one", F.col("qty") - F.col("qty") + 7).withColumn("few", F.col("qty"))
    rows = [(events, "duration_min", 60, 24), (events, "missing", 60, 24), (events, "resource", 60, 24),
            (lines, "qty", 10, 60), (lines, "one", 60, 24), (lines, "few", 60, 1)]
    parts = [b.cutoff_guards(df, c, cut, n).select(F.lit(c).alias("col"), "*") for df, c, cut, n in rows]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionAll(part)
    return result


@query("bin_cutoff_report", with_(LI, cutoff_edges("li", "qty", CUT, POINTS)) + f"""
SELECT CASE WHEN qty < {CUT} THEN CAST(CAST(trunc(qty) AS BIGINT) AS VARCHAR)
    ELSE CAST(CAST(lower AS BIGINT) AS VARCHAR) END AS bin, count(*) AS n,
  any_value(lower) AS lower, any_value(upper) AS upper
FROM li LEFT JOIN edges ON qty >= {CUT} AND qty >= lower AND qty < upper
GROUP BY 1""")
def bin_cutoff_report(spark, folder):
    hist = Histogram(quantities(spark, folder), "qty")
    return b.cutoff_report(hist, b.fit_cutoff(hist, CUT, POINTS))


@query("bin_two_phase", with_(EV, two_phase_sql("ev", "duration_min", T_CUT, Q_BINS)) + """
SELECT event_id, bin FROM binned""")
def bin_two_phase(spark, folder):
    binned, _ = b.two_phase_bins(minutes(spark, folder), "duration_min", T_CUT, Q_BINS)
    return binned.select("event_id", "bin")


@query("bin_two_phase_ranges", with_(EV, two_phase_sql("ev", "duration_min", T_CUT, Q_BINS)) + """
SELECT row_number() OVER (ORDER BY d) AS position, CAST(trunc(d) AS BIGINT) AS lower,
  CAST(trunc(coalesce(lead(d) OVER (ORDER BY d), (SELECT max(duration_min) FROM ev))) AS BIGINT) AS upper
FROM starts""")
def bin_two_phase_ranges(spark, folder):
    return b.two_phase_ranges(Histogram(minutes(spark, folder), "duration_min"), T_CUT, Q_BINS)


@query("bin_binary", with_(LI) + """
SELECT case_id, l_linenumber, l_partkey, l_suppkey, CASE WHEN over45 > 0 THEN 1 ELSE 0 END AS bin FROM li""")
def bin_binary(spark, folder):
    rows = line_log(spark, folder).select(
        "case_id", "l_linenumber", "l_partkey", "l_suppkey", b.binary_bin("over45").alias("bin"))
    return rows


@query("bin_balance", with_(EV, two_phase_sql("ev", "duration_min", T_CUT, Q_BINS),
                            "counts AS (SELECT bin, count(*) AS n FROM binned WHERE bin IS NOT NULL GROUP BY bin)") + f"""
SELECT CASE WHEN count(*) FILTER (bin >= {T_CUT}) > 1
    THEN max(n) FILTER (bin >= {T_CUT}) - min(n) FILTER (bin >= {T_CUT}) ELSE 0 END AS balance,
  count(*) FILTER (bin < {T_CUT}) AS individual_bins, count(*) FILTER (bin >= {T_CUT}) AS quantile_bins
FROM counts""")
def bin_balance(spark, folder):
    binned, _ = b.two_phase_bins(minutes(spark, folder), "duration_min", T_CUT, Q_BINS)
    return b.bin_balance(b.bin_counts(binned), T_CUT)


@query("bin_two_phase_report", with_(LI, two_phase_sql("li", "qty", T_CUT, Q_BINS),
                                     "counts AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin)") + f"""
SELECT count(*) FILTER (bin < {T_CUT}) AS individual_bins, count(*) FILTER (bin >= {T_CUT}) AS quantile_bins,
  round(avg(n) FILTER (bin >= {T_CUT}), 6) AS mean_size, round(stddev_samp(n) FILTER (bin >= {T_CUT}), 6) AS std_size,
  min(n) FILTER (bin >= {T_CUT}) AS min_size, max(n) FILTER (bin >= {T_CUT}) AS max_size,
  max(n) FILTER (bin >= {T_CUT}) - min(n) FILTER (bin >= {T_CUT}) AS balance,
  CAST(sum(n) FILTER (bin < {T_CUT}) AS BIGINT) AS individual_rows,
  min(bin) FILTER (bin < {T_CUT}) AS individual_lowest, max(bin) FILTER (bin < {T_CUT}) AS individual_highest
FROM counts""")
def bin_two_phase_report(spark, folder):
    hist = Histogram(quantities(spark, folder), "qty")
    report = b.two_phase_report(b.histogram_bin_counts(hist, b.fit_two_phase(hist, T_CUT, Q_BINS)), T_CUT)
    return report.withColumns({"mean_size": F.round("mean_size", 6), "std_size": F.round("std_size", 6)})


@query("bin_share_report", with_(LI, two_phase_sql("li", "qty", T_CUT, Q_BINS),
                                 "counts AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin)") + """
SELECT bin, n, round(CAST(n AS DOUBLE) / sum(n) OVER () * 100, 6) AS percent,
  CASE WHEN count(*) OVER () > 2 THEN max(n) OVER () - min(n) OVER () END AS balance
FROM counts""")
def bin_share_report(spark, folder):
    hist = Histogram(quantities(spark, folder), "qty")
    counts = b.histogram_bin_counts(hist, b.fit_two_phase(hist, T_CUT, Q_BINS))
    return b.bin_shares(counts, hist.summary.total).withColumn("percent", F.round("percent", 6))


@query("bin_binary_ratio", with_(LI) + """
SELECT z AS zero_rows, p AS nonzero_rows, round(CAST(greatest(z, p) AS DOUBLE) / least(z, p), 6) AS ratio FROM (
  SELECT count(*) FILTER (over45 = 0) AS z, count(*) FILTER (over45 > 0) AS p FROM li)""")
def bin_binary_ratio(spark, folder):
    hist = Histogram(quantities(spark, folder, "over45"), "over45")
    ratio = b.binary_ratio(b.histogram_bin_counts(hist, BinaryBinning()))
    return ratio.select(long(F.col("zero_rows"), "zero_rows"), long(F.col("nonzero_rows"), "nonzero_rows"),
                        r6("ratio", "ratio"))
