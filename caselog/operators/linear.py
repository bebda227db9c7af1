"""Softmax models on sparse rows, fitted by reweighted least squares with aggregated sums.

A round is one pass over the rows. Each row's probabilities weight its own curvature; per slot
and class the gradient and a curvature that bounds the true one (every value counts with the
row's sum of absolute values) are summed, map-side first, and each weight takes its Newton
step. The bound keeps the loss from rising, so there is no step size to search and a fixed
number of rounds always gives the same model. Several settings of strength and mixing are
arrays side by side, updated and scored by the same pass.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.constants import BROADCAST_BYTES
from caselog.functions.columns import argmax
from caselog.operators.evaluate import CLIP
from caselog.session import cut

LEAST_COUNT = 0.5   # of a class without training rows, in its prior


@dataclass(frozen=True)
class Setting:
    """Penalty `strength` on all weights but the constant's; `mixing` is the share of the absolute penalty."""

    strength: float = 0.01
    mixing: float = 0.0


def grid(strengths: tuple[float, ...], mixings: tuple[float, ...]) -> list[Setting]:
    return [Setting(s, m) for s, m in product(strengths, mixings)]


@dataclass(frozen=True)
class Model:
    """A stored table (slot, scale, weights), one row per slot; the weights of each setting's classes follow each other."""

    table: DataFrame
    slots: int
    classes: int
    settings: list[Setting]

    @property
    def small(self) -> bool:
        """Whether the weights may be given to every task."""
        return self.slots * (self.classes * len(self.settings) + 2) * 8 <= BROADCAST_BYTES

    def weights(self) -> DataFrame:
        """(setting, label_id, slot, weight) for values as they are, unscaled."""
        rows = self.table.select("slot", "scale", F.posexplode("weights").alias("place", "w"))
        return rows.select(
            F.floor(F.col("place") / self.classes).cast("int").alias("setting"),
            (F.col("place") % self.classes).cast("int").alias("label_id"), "slot", (F.col("w") / F.col("scale")).alias("weight"))

    def only(self, setting: int) -> Model:
        part = F.slice("weights", setting * self.classes + 1, self.classes)
        return Model(self.table.withColumn("weights", part), self.slots, self.classes, [self.settings[setting]])


def _entries() -> Column:
    return F.arrays_zip("slots", "values")


def _once(rows: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """`keep` and columns that are evaluated once: an explosion of one element is not merged with what reads them."""
    cell = rows.select(*keep, F.struct(*[c.alias(n) for n, c in made.items()]).alias("__cell"))
    return cell.select(*keep, F.explode(F.array("__cell")).alias("__once")).select(*keep, "__once.*")


def _let(value: Column, body) -> Column:
    """`body` of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_scores(rows: DataFrame, model: Model, key: str) -> DataFrame:
    """`rows` with `x`, the scaled values, and `scores`, one per class and setting."""
    width = model.classes * len(model.settings)
    zeros = F.array_repeat(F.lit(0.0), width)

    def added(total: Column, x: Column, weights: Column) -> Column:
        return F.zip_with(total, weights, lambda t, w: t + x * w)

    if model.small:
        # One row of all slots in order: an uncorrelated value, not a join.
        known = model.table.agg(F.array_sort(F.collect_list(F.struct("slot", "scale", "weights")))).scalar()
        given = rows.withColumn("__w", known)

        def scaled(c: Column) -> Column:
            return c["values"] / F.get("__w", c["slots"])["scale"]

        scores = F.aggregate(_entries(), zeros, lambda total, c: added(total, scaled(c), F.get("__w", c["slots"])["weights"]))
        return _once(given, rows.columns, x=F.transform(_entries(), scaled), scores=scores)
    cells = rows.select(key, F.posexplode(_entries()).alias("at", "c")).select(key, "at", F.col("c.slots").alias("slot"), "c.values")
    joined = cells.join(model.table, "slot").select(key, "at", (F.col("values") / F.col("scale")).alias("x"), "weights")
    sums = joined.select(key, "x", F.posexplode("weights").alias("place", "w")).groupBy(key, "place").agg(
        F.sum(F.col("x") * F.col("w")).alias("s"))
    scores = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "s"))).alias("scores"))
    scaled = joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("x"))
    return rows.join(scaled.select(key, F.col("x.x").alias("x")), key).join(
        scores.select(key, F.col("scores.s").alias("scores")), key)


def _softmax(scores: Column) -> Column:
    def shares(powers: Column) -> Column:
        return _let(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(powers, lambda p: p / total))

    return _let(scores, lambda given: _let(F.array_max(given), lambda top: _let(
        F.transform(given, lambda s: F.exp(s - top)), shares)))


def _by_setting(model: Model) -> Column:
    """An array of probabilities per setting."""
    return F.transform(F.sequence(F.lit(0), F.lit(len(model.settings) - 1)),
                       lambda s: _softmax(F.slice("scores", s * model.classes + 1, F.lit(model.classes))))


def start(train: DataFrame, slots: int, classes: int, settings: list[Setting]) -> Model:
    """All weights 0 but the constant's (the last slot), which give the classes' shares."""
    spark = train.sparkSession
    counts = train.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    every = spark.range(classes).select(F.col("id").cast("int").alias("label_id"))
    shares = every.join(counts, "label_id", "left").select(
        "label_id", F.log(F.greatest(F.coalesce("n", F.lit(0)), F.lit(LEAST_COUNT)) / total).alias("w"))
    prior = shares.agg(F.array_sort(F.collect_list(F.struct("label_id", "w"))).alias("p")).select(
        F.flatten(F.array_repeat(F.col("p.w"), len(settings)))).scalar()
    scales = train.select(F.explode(_entries()).alias("c")).groupBy(F.col("c.slots").alias("slot")).agg(
        F.max(F.abs("c.values")).alias("scale"))
    table = spark.range(slots).select(F.col("id").alias("slot")).join(scales, "slot", "left").select(
        "slot", F.coalesce("scale", F.lit(1.0)).alias("scale"),
        F.when(F.col("slot") == slots - 1, prior).otherwise(
            F.array_repeat(F.lit(0.0), classes * len(settings))).alias("weights"))
    return Model(cut(table, "weights"), slots, classes, settings)


def improved(train: DataFrame, model: Model, key: str = "case", rows: int | None = None) -> Model:
    """The model after one more round over `train`, of which `rows` may give the number of rows."""
    n = F.lit(float(train.count() if rows is None else rows))
    k = model.classes
    scored = _once(_with_scores(train, model, key), ["slots", "x", "label_id"], p=F.flatten(_by_setting(model)),
                   size=F.aggregate("x", F.lit(0.0), lambda a, x: a + F.abs(x)))
    cells = scored.select(F.explode(F.arrays_zip("slots", "x")).alias("c"), "label_id", "p", "size").select(
        F.col("c.slots").alias("slot"), "c.x", "label_id", "size", F.posexplode("p").alias("place", "p"))
    hit = (F.col("place") % k == F.col("label_id")).cast("double")
    sums = cells.groupBy("slot", "place").agg(
        (F.sum(F.col("x") * (hit - F.col("p"))) / n).alias("pull"),
        (F.sum(F.abs("x") * F.col("size") * F.col("p")) / n).alias("bend"))
    strength, mixing = (F.get(F.array(*[F.lit(float(v)) for v in values]), F.floor(F.col("place") / k).cast("int"))
                        for values in zip(*[(s.strength, s.mixing) for s in model.settings], strict=True))
    free = F.col("slot") == model.slots - 1
    ridge = F.when(free, F.lit(0.0)).otherwise(strength * (1 - mixing))
    edge = F.when(free, F.lit(0.0)).otherwise(strength * mixing)
    bend = F.col("bend") + ridge
    aim = F.col("w") + (F.col("pull") - ridge * F.col("w")) / bend
    moved = F.signum(aim) * F.greatest(F.abs(aim) - edge / bend, F.lit(0.0))
    rows = model.table.select("slot", "scale", F.posexplode("weights").alias("place", "w")).join(sums, ["slot", "place"], "left")
    table = rows.select("slot", "scale", "place", F.when(bend > 0, moved).otherwise(F.col("w")).alias("w")).groupBy(
        "slot").agg(F.first("scale").alias("scale"), F.array_sort(F.collect_list(F.struct("place", "w"))).alias("cells"))
    return Model(cut(table.select("slot", "scale", F.col("cells.w").alias("weights")), "weights"), model.slots, k, model.settings)


def fit(train: DataFrame, slots: int, classes: int, settings: list[Setting], rounds: int, key: str = "case") -> Model:
    """`train` is a stored table (key, label_id, slots, values); its last slot holds a constant."""
    model, n = start(train, slots, classes, settings), train.count()
    for _ in range(rounds):
        model = improved(train, model, key, n)
    return model


def probabilities(rows: DataFrame, model: Model, key: str = "case") -> DataFrame:
    """`rows` with `probability` (of the model's first setting) and `pred`, the first likeliest class."""
    kept = [c for c in rows.columns if c not in ("slots", "values")]
    scored = _once(_with_scores(rows, model, key), kept, probability=F.get(_by_setting(model), F.lit(0)))
    return scored.withColumn("pred", argmax("probability"))


def trial_counts(rows: DataFrame, model: Model, key: str = "case") -> DataFrame:
    """(setting, label_id, pred, n, loss): what every setting makes of `rows`, counted in one pass."""
    scored = _with_scores(rows, model, key).select("label_id", F.posexplode(_by_setting(model)).alias("setting", "p"))
    share = F.greatest(F.least(F.get("p", F.col("label_id")), F.lit(1.0 - CLIP)), F.lit(CLIP))
    return scored.groupBy("setting", "label_id", argmax("p").alias("pred")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(-F.log(share)).alias("loss"))


def trials(rows: DataFrame, model: Model, key: str = "case") -> DataFrame:
    """(trial, strength, mixing, accuracy, weighted_f1, loss) of every setting on `rows`, numbered from 1."""
    counts = cut(trial_counts(rows, model, key), "trials")
    n = F.col("n")
    truth = counts.groupBy("setting", F.col("label_id").alias("label")).agg(
        F.sum(n).alias("support"), F.sum(F.when(F.col("pred") == F.col("label_id"), n).otherwise(0)).alias("hits"))
    taken = counts.groupBy("setting", F.col("pred").alias("label")).agg(F.sum(n).alias("taken"))
    f1 = 2 * F.col("hits") / (F.col("support") + F.coalesce("taken", F.lit(0)))
    scores = truth.join(taken, ["setting", "label"], "left").groupBy("setting").agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"))
    losses = counts.groupBy("setting").agg((F.sum("loss") / F.sum(n)).alias("loss"))
    strengths, mixings = (F.lit([float(v) for v in values])
                          for values in zip(*[(s.strength, s.mixing) for s in model.settings], strict=True))
    return scores.join(losses, "setting").select(
        (F.col("setting") + 1).alias("trial"), F.get(strengths, F.col("setting")).alias("strength"),
        F.get(mixings, F.col("setting")).alias("mixing"), "accuracy", "weighted_f1", "loss")
