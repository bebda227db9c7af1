import inspect
import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caselog.llm import quality_fm, toxicity
from caselog.llm.sampling import fold, labelled_sample


def area(score, label):
    """Probability that a row with label 1 scores above one with label 0."""
    rank = np.argsort(np.argsort(score)) + 1
    ones = label.sum()
    return (rank[label == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(label) - ones))


def judged(spark, testdata, rows, label, held):
    labels = spark.read.parquet(f"{testdata}/sf0.1/labels.parquet")
    found = rows.join(labels, "doc_id").filter(F.col("held_out") == held).select("score", "predicted", label).toPandas()
    return found.score.to_numpy(), found.predicted.to_numpy(), found[label].to_numpy()


@pytest.fixture(scope="module")
def tables(spark, testdata):
    return [spark.read.parquet(f"{testdata}/sf0.1/{t}.parquet") for t in ("documents", "labels")]


def test_quality_on_held_out_rows(spark, testdata, tables):
    docs, labels = tables
    model = quality_fm.fit(docs, labels, fold(5) != 0)
    rows = quality_fm.scores(docs, model, fold(5) == 0).cache()
    assert rows.count() == docs.count() and rows.filter("score < 0 or score > 1").count() == 0
    score, predicted, label = judged(spark, testdata, rows, "quality", True)
    assert area(score, label) > 0.98 and (predicted == label).mean() > 0.95


def test_toxicity_on_held_out_rows(spark, testdata, tables):
    docs, labels = tables
    net = toxicity.fit(docs, labels, fold(4) != 2)
    rows = toxicity.scores(docs, net, fold(4) == 2).cache()
    assert rows.count() == docs.count()
    score, predicted, label = judged(spark, testdata, rows, "toxic", True)
    assert area(score, label) > 0.92 and (predicted == label).mean() > 0.95
    assert (predicted[label == 0] == 1).mean() < 0.01


def test_pairs_by_sums_of_squares():
    """The linear-time form equals the sum over all pairs of features."""
    rng = np.random.default_rng(1)
    model = quality_fm.Machine(0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    feature, value = np.array([3, 7, 7, 20, 29]), rng.normal(size=5)
    slow = 0.3 + model.weight[feature] @ value + sum(
        model.factor[feature[i]] @ model.factor[feature[j]] * value[i] * value[j]
        for i, j in itertools.combinations(range(5), 2))
    assert np.isclose(model.margin(1, np.zeros(5, dtype=int), feature, value)[0], slow)


def test_responses_stay_inside_a_text():
    rng = np.random.default_rng(2)
    net = toxicity.train([], np.array([]))
    net.tables[:] = rng.normal(size=net.tables.shape)
    net.read[:] = rng.normal(size=net.read.shape)
    texts = [rng.integers(0, toxicity.ROWS, (toxicity.TABLES, n)) for n in (1, 0, 2, 5, 9)]
    made = net.projected()
    bound = np.append(0, np.cumsum([t.shape[1] for t in texts]))
    together = net.margins(made, np.concatenate(texts, axis=1), bound)
    for k, text in enumerate(texts):
        words = sum(net.tables[t][text[t]] for t in range(toxicity.TABLES))
        pooled = []
        for width, f, b in zip(toxicity.WIDTHS, net.filters, net.bias, strict=True):
            found = [b + sum(words[i + j] @ f[j] for j in range(width)) for i in range(len(words) - width + 1)]
            pooled.append(np.maximum(np.max(found, axis=0), 0) if found else np.zeros(toxicity.FILTERS))
        assert np.isclose(together[k], np.concatenate(pooled) @ net.read + net.base, atol=1e-3)


def test_thresholds_by_language():
    score = np.concatenate([np.linspace(0, 0.2, 50), np.linspace(0.25, 0.3, 10), np.linspace(0, 0.6, 50), np.linspace(0.7, 1, 10), [0.9]])
    label = np.concatenate([np.zeros(50), np.ones(10), np.zeros(50), np.ones(10), [1]]).astype(int)
    found = toxicity.calibrate(score, label, ["de"] * 60 + ["en"] * 60 + [None])
    assert 0.2 < found["de"] <= 0.25 and 0.6 < found["en"] <= 0.7 and "" not in found


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, 0), (5, 0, 1), (None, 1, 1), (8, 1, 0), (77, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    everything = F.lit(True)
    assert labelled_sample(edge_docs, labels, "quality", everything, 2).select("doc_id").distinct().count() <= 2
    for module, label in ((quality_fm, "quality"), (toxicity, "toxic")):
        model = module.fit(edge_docs, labels, everything, label)
        rows = module.scores(edge_docs, model, fold(5) == 0).collect()
        assert len(rows) == edge_docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
        assert len({r.score for r in rows if r.doc_id == 2}) == 1
        assert all(r.held_out is False for r in rows if r.doc_id is None)
        assert module.scores(no_docs, model, fold(5) == 0).collect() == []
        empty = module.fit(no_docs, labels, everything, label)
        assert {r.score for r in module.scores(edge_docs, empty, fold(5) == 0).collect()} == {0.5}
        one = module.fit(edge_docs, labels.filter(f"{label} = 1"), everything, label)
        assert all(r.score > 0.5 for r in module.scores(edge_docs, one, fold(5) == 0).collect())
    kept = toxicity.without_toxic(edge_docs, toxicity.fit(edge_docs, labels, everything))
    assert kept.columns == edge_docs.columns


def test_empty_batch_of_features():
    batch = pa.RecordBatch.from_pydict({"text": pa.array([""]), "n_chars": pa.array([None], pa.float64())})
    (_, rows, _, feature, value), = quality_fm.features(batch)
    assert rows == 1 and len(feature) == 14 and np.isfinite(value).all()


def test_toxicity_trains_on_6000_labelled_documents(spark):
    """What `fit` takes at most by default, of a table with more labels."""
    docs = spark.range(6_500).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    rows = inspect.signature(toxicity.fit).parameters["rows"].default
    assert labelled_sample(docs, labels, "toxic", F.lit(True), rows).count() == 6_000


def test_a_doc_id_of_many_rows_is_one_of_the_sample(spark):
    docs = spark.range(3_000).select((F.col("id") % 30).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(docs.filter("doc_id = 3"))
    labels = spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 20).collect()
    again = labelled_sample(docs.repartition(5), labels, "toxic", F.lit(True), 20).collect()
    assert len(rows) == 20 and sorted(rows) == sorted(again)
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 20).columns == ["doc_id", "text", "__label"]


def test_words_of_the_sample_come_to_the_driver_in_two_bytes(spark, monkeypatch):
    """The network gets each text's table rows in order of doc_id, as short integers."""
    rows = [(i, " ".join(f"w{i * j}" for j in range(i % 7))) for i in range(40)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string").repartition(5)
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    given, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, marks: (given.append((list(texts), marks)), train(texts, marks))[1])
    toxicity.fit(docs, labels, F.lit(True))
    (texts, marks), = given
    mine = [r for r in rows if r[0] % toxicity.CALIBRATION]
    assert marks.tolist() == [i % 2 for i, _ in mine] and {t.dtype for t in texts} == {np.dtype(np.int16)}
    for text, (_, words) in zip(texts, mine, strict=True):
        (_, _, _, pair), = toxicity.word_rows(pa.array([words]))
        assert pair.tolist() == text.tolist()
