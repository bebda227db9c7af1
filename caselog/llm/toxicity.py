"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's embedding is the sum of rows of four tables, chosen by two hashes of the
word, so that two words share both only if both agree, and by hashes of its first
four and six bytes, so that inflected forms of a stem are alike. Filters of one, two and three words are
slid over the whole text, each keeps its largest response, and a logistic layer reads
these. Trained with numpy on a bounded labelled sample; the first embedding component
starts from the words' log odds in it, the rest small and random. A threshold is
calibrated for each language on a part of the sample that training does not use.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselog.llm.arrays import blocks
from caselog.llm.sampling import labelled_sample
from caselog.llm.tables import batch_of, give_back, map_columns, sent_if_small
from caselog.session import cut

TABLES = 4             # word, word again, and two beginnings of it
BEGINNINGS = (4, 6)    # bytes
ROWS = 1 << 15         # of each embedding table
SIZE = 6               # of an embedding
WIDTHS = (1, 2, 3)     # words under a filter
FILTERS = 6            # of each width
TRAIN_ROWS = 6_000     # labelled documents used at most
CALIBRATION = 5        # every fifth of them calibrates the thresholds
EPOCHS = 8
RATE = 0.05
DEFAULT = 0.3          # threshold of languages with too few labelled rows
LEAST_LABELS = 40      # of a language, for a threshold of its own


def word_rows(column: pa.Array):
    """For blocks of rows: (first row, rows, word bounds, table rows (TABLES, words))."""
    for block in blocks(column):
        with np.errstate(over="ignore"):
            hashed = block.hashes()
            begun = block.prefixes(BEGINNINGS)
        pair = np.stack([h >> np.uint64(49) for h in (hashed, hashed << np.uint64(20), *begun)]).astype(np.int32)
        yield block.first, block.rows, block.bound, pair


@dataclass
class Network:
    tables: np.ndarray          # (TABLES, ROWS, SIZE)
    filters: list[np.ndarray]   # by width: (width, SIZE, FILTERS)
    bias: list[np.ndarray]      # by width: (FILTERS,)
    read: np.ndarray            # (widths * FILTERS,)
    base: float
    thresholds: dict[str, float]

    def responses(self, tables: list[np.ndarray], pair: np.ndarray, bound: np.ndarray):
        """By width: the response at each word, -inf where the filter leaves the text."""
        for width, made, bias in zip(WIDTHS, tables, self.bias, strict=True):
            n = pair.shape[1]
            found = np.full((n, FILTERS), -np.inf, dtype=np.float32)
            if n >= width:
                total = bias.astype(np.float32) + np.zeros((n - width + 1, FILTERS), dtype=np.float32)
                for k in range(width):
                    for t in range(TABLES):
                        total += made[t, k][pair[t, k:n - width + 1 + k]]
                found[:n - width + 1] = total
                if width > 1:  # a filter may not reach into the next text
                    ends = bound[1:]
                    for back in range(1, width):
                        at = ends - back
                        found[at[(at >= 0) & (at >= bound[:-1])]] = -np.inf
            yield found

    def projected(self) -> list[np.ndarray]:
        """Filters applied to every table row: (TABLES, width, ROWS, FILTERS) by width."""
        return [np.einsum("trs,ksf->tkrf", self.tables, f).astype(np.float32) for f in self.filters]

    def margins(self, tables: list[np.ndarray], pair: np.ndarray, bound: np.ndarray) -> np.ndarray:
        full = np.flatnonzero(np.diff(bound) > 0)
        pooled = np.zeros((len(bound) - 1, len(self.read)), dtype=np.float32)
        for w, found in enumerate(self.responses(tables, pair, bound)):
            if len(full):
                top = np.maximum.reduceat(found, bound[full], axis=0)
                pooled[full, w * FILTERS:(w + 1) * FILTERS] = np.maximum(top, 0)
        return pooled @ self.read.astype(np.float32) + self.base


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _odds(texts: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """(TABLES, ROWS) log odds of label 1 given that a hash occurs in a text."""
    odds = np.zeros((TABLES, ROWS))
    ones, zeros = max(labels.sum(), 1), max((1 - labels).sum(), 1)
    for t in range(TABLES):
        with_one, with_zero = np.zeros(ROWS), np.zeros(ROWS)
        for text, label in zip(texts, labels, strict=True):
            (with_one if label else with_zero)[np.unique(text[t])] += 1
        found = np.log((with_one + 0.5) / (ones + 1)) - np.log((with_zero + 0.5) / (zeros + 1))
        # Few occurrences say little.
        odds[t] = found * np.minimum((with_one + with_zero) / 20, 1)
    return odds


def train(texts: list[np.ndarray], labels: np.ndarray, seed: int = 0) -> Network:
    """Gradient steps through the words that gave the largest responses.

    Without both labels the score is the share of label 1.
    """
    rng = np.random.default_rng(seed)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    net = Network(rng.normal(0, 0.05, (TABLES, ROWS, SIZE)), [rng.normal(0, 0.3, (w, SIZE, FILTERS)) for w in WIDTHS],
                  [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.3, len(WIDTHS) * FILTERS),
                  float(np.log(share / (1 - share))), {})
    if len(set(labels.tolist())) < 2:
        net.read[:] = 0
        return net
    net.tables[:, :, 0] = _odds(texts, labels) / 2
    for f, w in zip(net.filters, WIDTHS, strict=True):
        f[:, 0, 0] = 1.0 / w
    net.read[::FILTERS] = 1.0
    net.base -= 2.0
    state = [np.full(p.shape, 1e-1) for p in (net.tables, *net.filters, *net.bias, net.read)]
    base_state = 1e-1
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            part = [i for i in order[at:at + 32] if texts[i].shape[1]]
            if not part:
                continue
            pair = np.concatenate([texts[i] for i in part], axis=1)
            bound = np.append(0, np.cumsum([texts[i].shape[1] for i in part]))
            base_state = _step(net, pair, bound, labels[part], state, base_state)
    return net


def _step(net: Network, pair: np.ndarray, bound: np.ndarray, labels: np.ndarray, state: list, base_state: float) -> float:
    rows = len(labels)
    words = sum(net.tables[t][pair[t]] for t in range(TABLES))         # (words, SIZE)
    pooled, where = [], []
    for width, f, b in zip(WIDTHS, net.filters, net.bias, strict=True):
        n = len(words)
        found = np.full((n, FILTERS), -np.inf)
        if n >= width:
            found[:n - width + 1] = b + sum(words[k:n - width + 1 + k] @ f[k] for k in range(width))
        for back in range(1, width):
            at = bound[1:] - back
            found[at[at >= bound[:-1]]] = -np.inf
        best = np.stack([found[bound[r]:bound[r + 1]].argmax(axis=0) + bound[r] for r in range(rows)])
        value = np.take_along_axis(found, best, axis=0)
        pooled.append(np.maximum(value, 0))
        where.append((best, value > 0))
    hidden = np.concatenate(pooled, axis=1)
    error = (sigmoid(hidden @ net.read + net.base) - labels) / rows * 4
    back = error[:, None] * net.read[None, :]
    grads: list[np.ndarray] = [hidden.T @ error]
    table = np.zeros_like(words)
    f_grads, b_grads = [], []
    for w, (width, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        best, live = where[w]
        g = back[:, w * FILTERS:(w + 1) * FILTERS] * live
        fg = np.zeros_like(f)
        for k in range(width):
            place = np.minimum(best + k, len(words) - 1)
            fg[k] = np.einsum("rf,rfs->sf", g, words[place])
            np.add.at(table, place, g[:, :, None] * f[k].T[None, :, :])
        f_grads.append(fg)
        b_grads.append(g.sum(axis=0))
    used = np.flatnonzero(np.abs(table).sum(axis=1))
    for t in range(TABLES):
        rows_, place = np.unique(pair[t][used], return_inverse=True)
        g = np.zeros((len(rows_), SIZE))
        np.add.at(g, place, table[used])
        seen = state[0][t]
        seen[rows_] += g * g
        net.tables[t][rows_] -= RATE * g / np.sqrt(seen[rows_])
    for param, g, seen in zip((*net.filters, *net.bias, net.read), (*f_grads, *b_grads, *grads), state[1:], strict=True):
        seen += g * g
        param -= RATE * g / np.sqrt(seen)
    g = float(error.sum())
    net.base -= RATE * g / np.sqrt(base_state + g * g)
    return base_state + g * g


def calibrate(score: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> dict[str, float]:
    """The threshold of best F1 per language; the middle of the scores that give it."""
    found = {}
    groups = np.array([lang or "" for lang in langs], dtype=object)
    for lang in sorted(set(groups)):
        mine = groups == lang
        if mine.sum() < LEAST_LABELS or labels[mine].min() == labels[mine].max():
            continue
        cuts = np.linspace(0.1, 0.9, 81)
        f1 = []
        for cut in cuts:
            guess = score[mine] >= cut
            hit = float((guess & (labels[mine] == 1)).sum())
            f1.append(2 * hit / max(guess.sum() + labels[mine].sum(), 1))
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-12)
        found[lang] = float(round(cuts[best].mean(), 3))
    return found


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, label: str = "toxic", rows: int = TRAIN_ROWS) -> Network:
    """A network and its thresholds from at most `rows` labelled documents, whole texts.

    The hashed words of these come to the driver. The language is used for the
    thresholds only, never for a score.
    """
    sample = labelled_sample(docs, labels, label, allowed, rows)

    def work(batch: pa.RecordBatch):
        for first, n, bound, pair in word_rows(batch.column("text")):
            rows = pa.ListArray.from_arrays(pa.array((bound * TABLES).astype(np.int32)),
                                            pa.array(pair.T.ravel().astype(np.int16)))  # below ROWS
            yield batch_of(**{c: batch.column(c).slice(first, n) for c in ("doc_id", "label", "lang")}, rows=rows)

    lang = F.col("lang").cast("string") if "lang" in sample.columns else F.lit(None).cast("string")
    found = map_columns(sample, {"text": F.coalesce("text", F.lit("")), "doc_id": F.col("doc_id").cast("long"),
                                 "label": F.col("__label"), "lang": lang},
                        "doc_id long, label int, lang string, rows array<short>", work).toArrow()
    # The words stay where they came; only their order is sorted.
    order = np.argsort(found.column("doc_id").to_numpy(), kind="stable")
    marks = found.column("label").to_numpy()[order].astype(np.int64)
    rows_of = [np.asarray(r.values).reshape(-1, TABLES).T for r in found.column("rows")]
    texts = [rows_of[i] for i in order]
    mine = np.arange(len(marks)) % CALIBRATION != 0
    spoken = found.column("lang").to_pylist()
    langs = [spoken[i] for i in order]
    del found, rows_of
    net = train([t for t, m in zip(texts, mine, strict=True) if m], marks[mine])
    rest = [i for i in range(len(marks)) if not mine[i]]
    if rest:
        made = net.projected()
        score = np.array([sigmoid(net.margins(made, texts[i], np.array([0, texts[i].shape[1]])))[0] for i in rest])
        net.thresholds = calibrate(score, marks[rest], [langs[i] for i in rest])
    texts.clear()
    give_back()
    return net


def scores(docs: DataFrame, net: Network, held_out: Column, threshold: float = DEFAULT) -> DataFrame:
    """doc_id, text_hash, held_out, score (0 to 1), predicted, rejected: one row per row of `docs`, whole texts.

    `predicted` compares the score with `threshold`, `rejected` with the
    threshold of the row's language (`threshold` where there is none). Null and
    empty texts have no response and get the base score. A null doc_id is
    returned and never held out. Repeated rows are scored each. Other columns
    are ignored. An empty table gives no rows.
    """
    slim = Network(net.tables.astype(np.float32), net.filters, net.bias, net.read, net.base, net.thresholds)

    def run(batches):
        made = slim.projected()
        for batch in batches:
            for first, n, bound, pair in word_rows(batch.column("text")):
                score = np.round(sigmoid(slim.margins(made, pair, bound).astype(np.float64)), 6)
                langs = batch.column("lang").slice(first, n).to_pylist()
                limit = np.array([slim.thresholds.get(x or "", threshold) for x in langs])
                yield batch_of(**{c: batch.column(c).slice(first, n) for c in ("doc_id", "text_hash", "held_out")},
                               score=score, predicted=(score >= threshold).astype(np.int32), rejected=score >= limit)
        give_back()

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"), F.coalesce(held_out, F.lit(False)).alias("held_out"), lang.alias("lang"),
    ).mapInArrow(run, "doc_id long, text_hash long, held_out boolean, score double, predicted int, rejected boolean")


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of `docs` that the network does not reject, at their language's threshold.

    Equal texts of one doc_id go or stay together.
    """
    judged = scores(docs, net, F.lit(False)).filter("rejected").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    gone = sent_if_small(cut(judged, "rejected"), 32)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
