"""Quality classifier: a factorisation machine.

Features are hashed words, statistics of the text's structure and metadata (its
stated length). The score is sigmoid(b + sum w x + sum over pairs <v, v'> x x'),
where the sum over pairs is half of (sum v x)^2 - sum v^2 x^2, so that it takes
time linear in the features. Trained with numpy on a bounded labelled sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.arrays import Block, blocks
from caselog.llm.sampling import labelled_sample
from caselog.llm.tables import batch_of, map_columns

BUCKETS = 1 << 16
FACTORS = 8
TRAIN_ROWS = 6_000     # labelled documents used at most
EPOCHS = 12
RATE = 0.05
DECAY = 1e-4

_LETTER_CASES = ((0x41, 0x5B), (0x61, 0x7B), (0x30, 0x3A))
_STATISTICS = 14


def statistics(block: Block, stated: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """(rows, _STATISTICS) numbers of order 1 on the structure of each text."""
    data, rows = block.data, block.rows
    kinds = np.zeros(256, dtype=np.uint8)
    for number, (low, high) in enumerate(_LETTER_CASES, start=1):
        kinds[low:high] = number
    kinds[0x80:] = 2
    kinds[[0x20, *range(0x09, 0x0E)]] = 4
    kinds[[ord(c) for c in "#*$%&|<>"]] = 5
    kinds[[ord(c) for c in "!?"]] = 6
    kinds[0x0A] = 7
    kind = kinds[data]
    row = np.repeat(np.arange(rows), np.diff(block.at))
    counts = np.bincount(row * 8 + kind, minlength=rows * 8).reshape(rows, 8).astype(np.float64)
    size = np.maximum(np.diff(block.at), 1).astype(np.float64)
    words = np.diff(block.bound).astype(np.float64)
    some = np.maximum(words, 1)
    lines = counts[:, 7] + 1
    ends = np.where(words > 0, counts[:, 0] + counts[:, 5] + counts[:, 6], 0)
    return np.stack([
        np.log1p(words) / 8, np.log1p(size) / 10, np.log1p(np.maximum(stated, 0)) / 10,
        size / some / 8, counts[:, 1] / size, counts[:, 2] / size, counts[:, 3] / size,
        np.sqrt(counts[:, 5] / some), np.sqrt(counts[:, 6] / some), np.minimum(ends / some, 3),
        np.sqrt(distinct / some), np.log1p(some / lines) / 6, (words < 20).astype(float), (words == 0).astype(float),
    ], axis=1)


def features(batch: pa.RecordBatch):
    """For blocks of rows: (first row, row of each feature, feature, value)."""
    stated = batch.column("n_chars").to_numpy(zero_copy_only=False)
    stated = np.nan_to_num(stated.astype(np.float64))
    for block in blocks(batch.column("text")):
        with np.errstate(over="ignore"):
            words = (block.hashes() >> np.uint64(48)).astype(np.int64)
        row = np.repeat(np.arange(block.rows), np.diff(block.bound))
        key, count = np.unique(row * BUCKETS + words, return_counts=True)
        of, bucket = key // BUCKETS, key % BUCKETS
        value = np.log1p(count)
        length = np.sqrt(np.bincount(of, weights=value * value, minlength=block.rows))
        value /= np.maximum(length, 1e-9)[of]
        distinct = np.bincount(of, minlength=block.rows).astype(np.float64)
        numbers = statistics(block, stated[block.first:block.first + block.rows], distinct)
        every = np.repeat(np.arange(block.rows), _STATISTICS)
        where = np.tile(np.arange(BUCKETS, BUCKETS + _STATISTICS), block.rows)
        rows = np.concatenate([of, every])
        order = np.argsort(rows, kind="stable")
        yield (block.first, block.rows, rows[order], np.concatenate([bucket, where])[order],
               np.concatenate([value, numbers.ravel()])[order])


@dataclass
class Machine:
    bias: float
    weight: np.ndarray     # (features,)
    factor: np.ndarray     # (features, FACTORS)

    def margin(self, rows: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Linear time in the features: half of (sum v x)^2 - sum (v x)^2."""
        line = np.bincount(row, weights=self.weight[feature] * value, minlength=rows)
        ties = np.zeros(rows)
        for k in range(self.factor.shape[1]):
            part = self.factor[feature, k] * value
            total = np.bincount(row, weights=part, minlength=rows)
            ties += total * total - np.bincount(row, weights=part * part, minlength=rows)
        return self.bias + line + ties / 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> Machine:
    """Mini-batches with AdaGrad; without both labels the score is the share of label 1."""
    size = BUCKETS + _STATISTICS
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    model = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)))
    if len(set(labels.tolist())) < 2:
        model.factor[:] = 0
        return model
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at:at + 64]
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            feature = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            error = (sigmoid(model.margin(len(part), row, feature, value)) - labels[part]) / len(part) * 8
            used, place = np.unique(feature, return_inverse=True)
            step = error[row] * value
            g = np.bincount(place, weights=step) + DECAY * model.weight[used]
            seen_w[used] += g * g
            new_w = model.weight[used] - RATE * g / np.sqrt(seen_w[used])
            for k in range(FACTORS):
                v = model.factor[feature, k]
                total = np.bincount(row, weights=v * value, minlength=len(part))
                g = np.bincount(place, weights=step * (total[row] - v * value)) + DECAY * model.factor[used, k]
                seen_v[used, k] += g * g
                model.factor[used, k] -= RATE * g / np.sqrt(seen_v[used, k])
            model.weight[used] = new_w
            g = error.sum()
            seen_b += g * g
            model.bias -= RATE * g / np.sqrt(seen_b)
    return model


def _columns(docs: DataFrame, **more: Column) -> dict[str, Column]:
    stated = F.col("n_chars").try_cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return {"text": F.coalesce("text", F.lit("")), "n_chars": stated, **more}


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """A machine trained on at most `rows` labelled documents; their features come to the driver."""
    sample = labelled_sample(docs, labels, label, allowed, rows)

    def work(batch: pa.RecordBatch):
        marks = batch.column("label")
        for first, n, row, feature, value in features(batch):
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
            yield batch_of(
                doc_id=batch.column("doc_id").slice(first, n), label=marks.slice(first, n),
                feature=pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))),
                value=pa.ListArray.from_arrays(pa.array(ends), pa.array(value.astype(np.float32))))

    found = map_columns(sample, _columns(sample, doc_id=F.col("doc_id").cast("long"), label=F.col("__label")),
                        "doc_id long, label int, feature array<int>, value array<float>", work).toArrow().sort_by("doc_id")
    made = [(np.asarray(f.values), np.asarray(v.values, dtype=np.float64))
            for f, v in zip(found.column("feature"), found.column("value"), strict=True)]
    return train(made, np.array(found.column("label").to_pylist(), dtype=np.float64))


def scores(docs: DataFrame, model: Machine, held_out: Column, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: one row per row of `docs`, whole texts.

    Null and empty texts are scored from their statistics. A null doc_id is
    returned and never held out. Repeated rows are scored each. Columns other
    than doc_id, text and n_chars are ignored. An empty table gives no rows.
    """
    slim = Machine(model.bias, model.weight.astype(np.float32), model.factor.astype(np.float32))

    def work(batch: pa.RecordBatch):
        for first, n, row, feature, value in features(batch):
            score = np.round(sigmoid(slim.margin(n, row, feature, value)), 6)
            yield batch_of(doc_id=batch.column("doc_id").slice(first, n), held_out=batch.column("held_out").slice(first, n),
                           score=score, predicted=(score >= threshold).astype(np.int32))

    return map_columns(docs, _columns(docs, doc_id=F.col("doc_id").cast("long"),
                                      held_out=F.coalesce(held_out, F.lit(False))),
                       "doc_id long, held_out boolean, score double, predicted int", work)
