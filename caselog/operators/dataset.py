"""Assembly of model inputs by case, and splits into training and test cases.

A split is fitted to one threshold per class (or one in all); applying it compares
a hash of the case with the threshold of its class, for any number of classes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselog.constants import SMALL_ROWS
from caselog.functions.columns import as_column
from caselog.operators.ordered import Ordered, Position
from caselog.session import cut

HASH_BUCKET = 4      # leading hex digits: 65,536 buckets


# -- assembly ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Assembled:
    steps: DataFrame     # (case, step, one vector column per input)
    cases: DataFrame     # (case, features, label columns)


def assembled(inputs: dict[str, DataFrame], cases: DataFrame) -> Assembled:
    """Join step rows `(case, step, vec)` of several inputs and the case table by key.

    For inputs from different tables; those of one log are built together by
    `step_vectors` and need `with_cases` only. Only cases that occur in all inputs
    stay. Steps are joined by (case, step), which spreads a long case over the tasks.
    """
    named = [rows.select("case", "step", F.col("vec").alias(name)) for name, rows in inputs.items()]
    joined = reduce(lambda a, b: a.join(b, ["case", "step"]), named)
    return with_cases(joined, cases, *[rows.select("case") for rows in inputs.values()])


def with_cases(steps: DataFrame, cases: DataFrame, *present: DataFrame) -> Assembled:
    """Steps and cases restricted to each other by case key.

    Case attributes are kept apart and not copied to every step. `present` may give
    cheaper tables that hold the same case keys as the steps.
    """
    keys = [p.select("case").distinct() for p in present or (steps,)]
    return Assembled(
        steps.join(cases.select("case"), "case", "left_semi"),
        reduce(lambda a, b: a.join(b, "case", "left_semi"), keys, cases),
    )


# -- stratified split ---------------------------------------------------------------------


def case_hash(case: Column | str, seed: int = 42) -> Column:
    """Pseudo-random text that depends on the seed and the case only."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), as_column(case).cast("string")))


@dataclass(frozen=True)
class StratifiedSplit:
    """Training cases of a class are those up to the class's hash threshold.

    `thresholds` is a stored table (label, last), one row per class, `last` null for
    a class without training cases. A case without label, or with a label unknown
    to the fit, belongs to no part.
    """

    case: str
    label: str
    seed: int
    thresholds: DataFrame

    def apply(self, df: DataFrame, name: str = "split") -> DataFrame:
        last = self.thresholds.select(F.col("label").alias("__label"), F.coalesce("last", F.lit("")).alias("__last"))
        # '' sorts before every hash.
        train = case_hash(self.case, self.seed) <= F.col("__last")
        joined = df.join(last, df[self.label] == last["__label"], "left")
        return joined.withColumn(name, F.when(train, "train").when(~train, "test")).drop("__label", "__last")


def class_quotas(cases: DataFrame, label: str, test_share: float = 0.2) -> DataFrame:
    """(label, n, train): training quota of each class, by largest remainder.

    The test part has ceil(share * n) cases. One row per class, so a single window
    over the classes is enough.
    """
    counts = cases.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    train = total - F.ceil(total * F.lit(test_share)).cast("long")
    share = F.col("n") * F.col("train_rows") / F.col("total")
    floors = counts.select("label", "n", total.alias("total"), train.alias("train_rows")).select(
        "*", F.floor(share).cast("long").alias("whole"), (share - F.floor(share)).alias("rest"))
    order = Window.orderBy(F.desc("rest"), "label")
    spare = F.col("train_rows") - F.sum("whole").over(everything)
    extra = (F.row_number().over(order) <= spare).cast("long")
    return floors.select("label", "n", (F.col("whole") + extra).alias("train"))


def fit_stratified(cases: DataFrame, case: str, label: str, test_share: float = 0.2,
                   seed: int = 42) -> StratifiedSplit:
    """Find the hash that cuts off each class's quota.

    Hash-prefix counts tell the bucket in which the quota ends; only that bucket's
    cases (about 1 in 65,536 of a class) are ranked.
    """
    quotas = cut(class_quotas(cases, label, test_share), "quotas")
    if quotas.filter("n < 2").limit(1).count():
        raise ValueError("a class with a single case cannot be split")
    hashed = cases.filter(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), case_hash(case, seed).alias("h")).withColumn("prefix", F.substring("h", 1, HASH_BUCKET))
    so_far = Window.partitionBy("label").orderBy("prefix").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ends = (
        hashed.groupBy("label", "prefix").agg(F.count(F.lit(1)).alias("k"))
        .withColumn("upto", F.sum("k").over(so_far)).join(quotas, "label")
        .filter((F.col("upto") >= F.col("train")) & (F.col("upto") - F.col("k") < F.col("train")))
        .select("label", "prefix", (F.col("train") - (F.col("upto") - F.col("k"))).alias("take"))
    )
    order = Window.partitionBy("label").orderBy("h")
    last = (
        hashed.join(cut(ends, "ends"), ["label", "prefix"]).withColumn("place", F.row_number().over(order))
        .filter(F.col("place") == F.col("take")).select("label", F.col("h").alias("last"))
    )
    return StratifiedSplit(case, label, seed, cut(quotas.select("label").join(last, "label", "left"), "thresholds"))


# -- tail split -----------------------------------------------------------------------------


@dataclass(frozen=True)
class TailSplit:
    case: str
    last_train: object

    def apply(self, df: DataFrame, name: str = "split") -> DataFrame:
        if self.last_train is None:
            return df.withColumn(name, F.lit("validation"))
        first = F.col(self.case) <= F.lit(self.last_train)
        return df.withColumn(name, F.when(first, "train").otherwise("validation"))


def fit_tail(cases: DataFrame, case: str, share: float = 0.2, limit: int = SMALL_ROWS) -> TailSplit:
    """The last `share` of the cases in key order becomes the validation part."""
    keys = cases.filter(F.col(case).isNotNull()).select(case).distinct()
    n = keys.count()
    train = math.floor(n * (1.0 - share))
    if train == 0:
        return TailSplit(case, None)
    ranked = Ordered(keys, [], [case], n, limit).add(place=Position()).result()
    return TailSplit(case, ranked.filter(F.col("place") == train - 1).first()[case])
