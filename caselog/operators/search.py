"""Distribution analysis, parameter search and choice of a binning strategy.

Everything here is computed from a column's value counts (`Histogram`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.operators.binning import bin_starts, histogram_bin_counts
from caselog.operators.histogram import Histogram

# Fixed values of the parameter search.
SMALL_VALUES = 20                         # distinct values looked at
COVERED_PERCENT = 80.0                    # stop after this cumulative share
SHARE_THRESHOLDS = [5.0, 10.0, 15.0, 20.0, 25.0]
LARGEST_SHARE_VALUE = 20.0
FREQUENT_SHARE = 0.01
DROP_FACTOR = 3
RARE_SHARE = 0.005
T_CUT_RANGE = (2, 25)
Q_BINS_RANGE = (5, 50)
DEFAULT_T_CUTS = [3, 5, 7, 10]
DEFAULT_Q_BINS = [10, 15, 20, 25]
TARGET_BY_ROWS = [(1_000, 10), (10_000, 20), (100_000, 30)]
LARGEST_TARGET = 50
MAX_PAIRS = 50
GOOD_BALANCE = 10
FEW_BINS, FEW_BINS_PENALTY = 3, 1000
MANY_BINS, MANY_BINS_PENALTY = 50, 100
FALLBACK_T_CUT, FALLBACK_Q_BINS = 5, 15

# Fixed values of the strategy choice.
CHECKED_VALUES = 50
ZERO_OVERWHELMS = 0.85
SMALL_MATTERS = 0.10
CUTOFF_RANGE = (2, 20)
PRESERVED_Q_BINS = (8, 25)
BINARY, PRESERVE, STANDARD = "binary_zero_nonzero", "two_phase_preserve_small", "two_phase_standard"


# -- distribution -------------------------------------------------------------------


def small_values(hist: Histogram) -> DataFrame:
    """The smallest values with cumulative counts, up to the one that passes 80 %."""
    s = hist.summary
    so_far = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hist.smallest(SMALL_VALUES).select("value", "n", F.sum("n").over(so_far).alias("upto"))
    before = (F.col("upto") - F.col("n")) / F.lit(s.total) * 100
    return rows.filter(before <= COVERED_PERCENT).select(
        "value", "n", "upto",
        (F.col("upto") / F.lit(s.total) * 100).alias("percent"),
        F.lit(s.total).cast("long").alias("total"),
        F.lit(s.distinct).cast("long").alias("distinct_values"),
        F.lit(s.lowest).alias("lowest"), F.lit(s.highest).alias("highest"),
    )


def _passing(hist: Histogram) -> DataFrame:
    """(value): the first value at which the share of rows reaches each threshold."""
    name, rows = hist.names[0], hist.summary.total
    if not hist.long:
        percent = F.col("upto") / F.lit(rows) * 100
        return hist.cumulative().agg(F.array(*[
            F.min(F.when(percent >= t, F.col("value"))) for t in SHARE_THRESHOLDS
        ]).alias("values")).select(F.explode("values").alias("value"))
    ranks = []
    for t in SHARE_THRESHOLDS:
        least = max(1, int(t * rows / 100) - 2)   # the same comparison of doubles, near its border
        while least / rows * 100 < t:
            least += 1
        ranks.append(least - 1)
    places = hist.places_at({name: [r for r in ranks if r < hist.summary.valid]}).get(name, {})
    return hist.rows.sparkSession.createDataFrame(sorted({(p.value,) for p in places.values()}), "value double")


def t_cut_candidates(hist: Histogram) -> DataFrame:
    """(t_cut) distinct, inside the admitted range; at most 24 rows."""
    total = F.lit(hist.summary.total)
    by_share = _passing(hist).filter(F.col("value") <= LARGEST_SHARE_VALUE).select(
        (F.col("value") + 1).alias("value"))

    frequent = hist.values.filter(F.col("n") >= total * FREQUENT_SHARE)
    by_frequency = frequent.agg((F.max("value") + 1).alias("value"))

    order = Window.orderBy("value")
    drops = hist.smallest(SMALL_VALUES).withColumn("prev", F.lag("n").over(order))
    by_drop = drops.filter(
        (F.col("prev") > F.col("n") * DROP_FACTOR) & (F.col("n") < total * RARE_SHARE)
    ).select("value")

    low, high = T_CUT_RANGE
    return (
        by_share.unionAll(by_frequency).unionAll(by_drop)
        .filter((F.col("value") >= low) & (F.col("value") < high + 1))
        .select(F.col("value").cast("int").alias("t_cut")).distinct()
    )


def target_bins(total: Column, distinct: Column) -> Column:
    """Total number of bins to aim at, from the size of the data."""
    target = F.when(F.lit(False), F.lit(0))
    for rows, bins in TARGET_BY_ROWS:
        target = target.when(total < rows, F.least(F.lit(bins), distinct))
    return target.otherwise(F.least(F.lit(LARGEST_TARGET), distinct)).cast("int")


def suggestions(hist: Histogram, target: int | None = None) -> DataFrame:
    """One row: candidate arrays `t_cuts` and `q_bins`, defaults applied, and `target`."""
    s = hist.summary
    wanted = (F.lit(int(target)) if target is not None
              else target_bins(F.lit(s.total), F.lit(s.distinct).cast("int")))
    found = t_cut_candidates(hist).agg(F.array_sort(F.collect_list("t_cut")).alias("found"))

    def around(t: Column) -> Column:
        rest = F.greatest(F.lit(5), F.col("target") - t)
        return F.array(rest - 2, rest, rest + 2)

    spread = F.flatten(F.transform("found", around))
    q_found = F.array_sort(F.array_distinct(F.filter(spread, lambda q: q.between(*Q_BINS_RANGE))))
    return found.withColumn("target", wanted).withColumn("q_found", q_found).select(
        _or_default("found", DEFAULT_T_CUTS).alias("t_cuts"),
        _or_default("q_found", DEFAULT_Q_BINS).alias("q_bins"),
        "target",
    )


def _or_default(name: str, default: list[int]) -> Column:
    return F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(*[F.lit(d) for d in default]))


# -- grid and search ------------------------------------------------------------------


def parameter_grid(ranges: DataFrame, target: int | None = None, cap: int = MAX_PAIRS,
                   seed: int = 42) -> DataFrame:
    """(t_cut, q_bins, rank) from one row of candidate arrays.

    Beyond `cap` pairs the nearest to `target` stay if one was asked for, else a
    sample that depends on the seed only.
    """
    grid = ranges.select(F.posexplode("t_cuts").alias("i", "t_cut"), "q_bins").select(
        "i", "t_cut", F.posexplode("q_bins").alias("j", "q_bins"))
    if target is not None:
        choice = F.abs(F.col("t_cut") + F.col("q_bins") - int(target)).cast("long")
    else:
        choice = F.md5(F.concat_ws(":", F.lit(str(seed)), "t_cut", "q_bins"))
    everything = Window.partitionBy()
    natural = Window.orderBy("i", "j")
    chosen = Window.orderBy("choice", "i", "j")
    ranked = grid.withColumn("choice", choice).select(
        "t_cut", "q_bins",
        F.when(F.count(F.lit(1)).over(everything) > cap, F.row_number().over(chosen))
        .otherwise(F.row_number().over(natural)).alias("rank"),
    )
    return ranked.filter(F.col("rank") <= cap)


def pair_scores(hist: Histogram, pairs: list[tuple[int, int, int]]) -> DataFrame:
    """(t_cut, q_bins, rank, bins, balance, score) of every (t_cut, q_bins, rank), in one job.

    A bin's size is the difference of the row counts below its start and below the
    next start, so scoring needs only the bin starts.
    """
    starts = bin_starts(hist, pairs)
    order = Window.partitionBy("rank").orderBy("value")
    rows = F.coalesce(F.lead("before").over(order), F.lit(hist.summary.valid)) - F.col("before")
    bins = (
        starts.withColumn("rows", rows)
        .groupBy("rank", F.col("value").cast("long").alias("bin")).agg(F.sum("rows").alias("rows"))
        .groupBy("rank").agg(F.count(F.lit(1)).alias("bins"),
                             (F.max("rows") - F.min("rows")).alias("balance"))
    )
    spark = hist.rows.sparkSession
    asked = spark.createDataFrame(pairs, "t_cut int, q_bins int, rank int")
    n, balance = F.coalesce("bins", F.lit(0)), F.coalesce("balance", F.lit(0))
    penalty = (F.when(n < FEW_BINS, FEW_BINS_PENALTY).when(n > MANY_BINS, MANY_BINS_PENALTY).otherwise(0))
    return asked.join(bins, "rank", "left").select(
        "t_cut", "q_bins", "rank", n.alias("bins"), balance.alias("balance"),
        (balance + penalty).cast("long").alias("score"),
    )


def best_pair(scores: DataFrame) -> DataFrame:
    """One row: the first pair scoring 10 or less, else the lowest score, first on ties."""
    good = F.col("score") <= GOOD_BALANCE
    key = F.struct(~good, F.when(good, F.lit(0)).otherwise(F.col("score")), F.col("rank"))
    best = F.min_by(F.struct("t_cut", "q_bins", "score"), key)
    return scores.agg(best.alias("best")).filter(F.col("best").isNotNull()).select("best.*")


def fallback_pair(ranges: DataFrame) -> DataFrame:
    """One row: the middle element of each range."""

    def middle(name: str, default: int) -> Column:
        value = F.get(F.col(name), (F.size(name) / 2).cast("int"))
        return F.coalesce(value, F.lit(default))

    return ranges.select(
        middle("t_cuts", FALLBACK_T_CUT).alias("t_cut"), middle("q_bins", FALLBACK_Q_BINS).alias("q_bins"))


@dataclass(frozen=True)
class Found:
    t_cut: int
    q_bins: int
    score: int | None


def find_parameters(hist: Histogram, t_cuts: list[int] | None = None, q_bins: list[int] | None = None,
                    cap: int = MAX_PAIRS, target: int | None = None, seed: int = 42) -> Found:
    """Best pair of the given or suggested ranges; reads at most `cap` pairs to the driver."""
    ranges = search_ranges(hist, t_cuts, q_bins, target)
    grid = parameter_grid(ranges, target, cap, seed)
    pairs = [(r["t_cut"], r["q_bins"], r["rank"]) for r in grid.collect()]
    best = best_pair(pair_scores(hist, pairs)).collect() if pairs else []
    if not best:
        middle = fallback_pair(ranges).first()
        return Found(middle["t_cut"], middle["q_bins"], None)
    return Found(best[0]["t_cut"], best[0]["q_bins"], best[0]["score"])


def search_ranges(hist: Histogram, t_cuts: list[int] | None = None, q_bins: list[int] | None = None,
                  target: int | None = None) -> DataFrame:
    """One row of ranges: those given, the others suggested from the data."""
    ranges = suggestions(hist, target)
    if t_cuts is not None:
        ranges = ranges.withColumn("t_cuts", F.lit(t_cuts).cast("array<int>"))
    if q_bins is not None:
        ranges = ranges.withColumn("q_bins", F.lit(q_bins).cast("array<int>"))
    return ranges


def detected_phases(hist: Histogram, binning) -> DataFrame:
    """One row: cut and number of quantile bins read back from a finished binning.

    A bin counts as individual if it holds one value and is named after it.
    """
    bins = (
        hist.values.select("value", binning.bin("value").alias("bin"))
        .filter(F.col("bin").isNotNull())
        .groupBy("bin").agg(F.count(F.lit(1)).alias("values"), F.min("value").alias("lowest"))
    )
    own = (F.col("values") == 1) & (F.col("lowest") == F.col("bin"))
    return bins.agg(
        (F.coalesce(F.max(F.when(own, F.col("bin"))), F.lit(float(FALLBACK_T_CUT - 1))) + 1)
        .alias("t_cut"),
        F.count(F.when(~own, 1)).alias("q_bins"),
        F.count(F.lit(1)).alias("bins"),
    )


def reported_cut(hist: Histogram, binning) -> DataFrame:
    """One row: 1 + the largest bin below the top one, as reported after a search."""
    bins = histogram_bin_counts(hist, binning)
    top = bins.agg(F.max("bin")).scalar()
    return bins.filter(F.col("bin") < top).agg((F.max("bin") + 1).alias("t_cut"))


# -- strategy ---------------------------------------------------------------------------


def whole_small_values(hist: Histogram) -> DataFrame:
    """(value, n) of the whole values 1, 2, ... below 50 and not above the maximum; at most 49 rows."""
    top = min(CHECKED_VALUES, int(hist.summary.highest or 0) + 1)
    v = F.col("value")
    return hist.values.filter((v >= 1) & (v < top) & (v == F.floor(v))).select(v.cast("int").alias("value"), "n")


def small_value_cutoff(hist: Histogram, min_percent: float = 1.0) -> DataFrame:
    """One row `cutoff`: where small values with a substantial share end.

    Median of the candidates from four rules: a drop below half, a share under
    `min_percent`, more than 20 % covered, a gap; without candidates, the end of
    the leading run of values that reach `min_percent`.
    """
    total = F.lit(hist.summary.total)
    order = Window.orderBy("value")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value, n = F.col("value"), F.col("n")
    rows = whole_small_values(hist).select(
        value, n,
        (n / total * 100).alias("percent"),
        F.lag("n").over(order).alias("prev"),
        F.lead("value").over(order).alias("next"),
        (F.sum("n").over(so_far) / total * 100).alias("covered"),
    )
    share, covered = F.col("percent"), F.col("covered")
    drop = (n < F.col("prev") * 0.5) & (F.col("prev") > total * 0.01)
    gap = (F.col("next") - value > 2) & (value <= 15)
    facts = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.collect_list(F.when(drop, value)).alias("drops"),
        F.min(F.when(share < min_percent, value)).alias("rare"),
        F.min(F.when((covered > 20) & (value <= 10), value + 1)).alias("enough"),
        F.collect_list(F.when(gap, value + 1)).alias("gaps"),
        F.min(F.when(share < 1.0, value)).alias("first_rare"),
        F.collect_list(value).alias("values"),
    )
    single = F.filter(F.array("rare", "enough"), lambda c: c.isNotNull())
    candidates = F.array_sort(F.concat("drops", single, "gaps"))
    size = F.size("candidates")
    middle = (
        F.get("candidates", ((size - 1) / 2).cast("int")) + F.get("candidates", (size / 2).cast("int"))
    ) / 2
    run = F.filter("values", lambda v: v < F.coalesce("first_rare", F.lit(CHECKED_VALUES)))
    run_end = F.array_max(run) + 1
    return facts.withColumn("candidates", candidates).select(
        F.when(F.col("rows") == 0, 1)
        .when(size > 0, F.greatest(F.lit(CUTOFF_RANGE[0]), F.least(middle.cast("int"), F.lit(CUTOFF_RANGE[1]))))
        .otherwise(F.coalesce(run_end, F.lit(2))).alias("cutoff")
    )


def zero_pattern(hist: Histogram, zero_threshold: float = 0.5) -> DataFrame:
    """One row: strategy, shares, cutoff, parameters and reasons."""
    total = F.lit(hist.summary.total)
    v, n = F.col("value"), F.col("n")
    facts = hist.values.agg(
        F.coalesce(F.sum(F.when(v == 0, n)), F.lit(0)).alias("zero_rows"),
        F.count(F.when(v > 0, 1)).alias("positive_values"),
    ).select(
        "zero_rows", "positive_values",
        (F.col("zero_rows") / total).alias("zero_share"),
        small_value_cutoff(hist).scalar().alias("cutoff"),
    )
    small = whole_small_values(hist)
    upto_cutoff = facts.select("cutoff").scalar()
    small_rows = small.filter(F.col("value") < upto_cutoff).agg(F.coalesce(F.sum("n"), F.lit(0)))
    facts = facts.withColumn("small_share", small_rows.scalar() / total)

    zero, part, cutoff = F.col("zero_share"), F.col("small_share"), F.col("cutoff")
    dominant = zero > zero_threshold
    strategy = (
        F.when(zero > ZERO_OVERWHELMS, BINARY)
        .when(dominant & (part > SMALL_MATTERS), PRESERVE)
        .when(dominant, BINARY)
        .otherwise(STANDARD)
    )
    zero_text = F.format_string("%.1f%%", zero * 100)
    part_text = F.format_string("%.1f%%", part * 100)
    below = (cutoff - 1).cast("string")
    reasons = (
        F.when(zero > ZERO_OVERWHELMS, F.array(F.concat(F.lit("zero share "), zero_text)))
        .when(dominant & (part > SMALL_MATTERS), F.array(
            F.concat(F.lit("zero share "), zero_text, F.lit(", values 1-"), below, F.lit(" hold "), part_text),
            F.concat(F.lit("small values end at "), cutoff.cast("string")),
            F.lit("small values keep their own bins")))
        .when(dominant, F.array(
            F.concat(F.lit("zero share "), zero_text),
            F.concat(F.lit("small non-zero values hold only "), part_text),
            F.concat(F.lit("values 1-"), below, F.lit(" are not substantial"))))
        .otherwise(F.array(F.concat(F.lit("balanced, zero share "), zero_text)))
    )
    preserve = F.col("strategy") == PRESERVE
    low, high = PRESERVED_Q_BINS
    third = F.floor(F.col("positive_values") / 3).cast("int")
    return facts.withColumn("strategy", strategy).select(
        "strategy", "zero_rows", "positive_values",
        (zero * 100).alias("zero_percent"), "cutoff", (part * 100).alias("small_percent"),
        F.when(preserve, cutoff).alias("t_cut"),
        F.when(preserve, F.greatest(F.lit(low), F.least(F.lit(high), third))).alias("q_bins"),
        reasons.alias("reasons"),
    )
