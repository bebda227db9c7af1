"""Every stage against plain Python, on what the stage before it kept."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from caselog.llm import mixing, toxicity
from caselog.llm.queries import tokenizer_path
from caselog.llm.sampling import fold
from test_decontaminate import brute_force as leaks
from test_near_dup import brute_force as groups


@pytest.fixture(scope="module")
def stages(spark, testdata):
    folder = f"{testdata}/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(stage(spark, found[-1], folder).cache())
    return folder, found


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    _, found = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    assert all(df.dtypes == found[0].dtypes for df in found[1:-1])


def test_toxic_documents_go(spark, stages):
    folder, found = stages
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    net = toxicity.fit(found[0], labels, fold(4) != 2)
    judged = toxicity.scores(found[0], net, fold(4) == 2).collect()
    assert sorted(r.doc_id for r in judged if not r.rejected) == sorted(i for i, _ in rows(found[1]))


def test_one_of_each_group_stays(stages):
    _, found = stages
    expected = [i for i, (_, first) in groups(rows(found[1]), 5).items() if i == first]
    assert sorted(expected) == sorted(i for i, _ in rows(found[2]))


def test_leaks_go(spark, stages):
    folder, found = stages
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    bad = {d for d, _ in leaks(rows(found[2]), items)}
    assert sorted(i for i, _ in rows(found[2]) if i not in bad) == sorted(i for i, _ in rows(found[3]))


def test_mixture(stages):
    _, found = stages
    taken = mixing.mixed(found[3], percent=100).filter("tokens_taken = n_tokens").collect()
    assert sorted(r.doc_id for r in taken) == sorted(i for i, _ in rows(found[4]))
    assert dict(rows(found[4])).items() <= dict(rows(found[3])).items()


def test_tokens(stages):
    from tokenizers import Tokenizer

    _, found = stages
    tokenizer = Tokenizer.from_file(tokenizer_path())
    start = 0
    texts = sorted(rows(found[4]))
    made = sorted(found[5].collect(), key=lambda r: r.start)
    assert len(made) == len(texts)
    for r, (doc_id, text) in zip(made, texts, strict=True):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens) == (doc_id, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_run_writes_every_stage_and_reads_it_again(spark, testdata, monkeypatch):
    """Each stage gets what the one before it returned, from a written table."""
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append((docs.count(), docs.inputFiles()[0], sf_dir))
        return docs.filter("doc_id % 10 <> 0") if len(seen) == 1 else docs.limit(5)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    folder = f"{testdata}/sf0.001"
    assert corpus_pipeline.run(spark, folder).count() == 5
    assert [n for n, _, _ in seen] == [200, 180] and all(f == folder for _, _, f in seen)
    assert seen[0][1].endswith("documents.parquet") and "/one/" in seen[1][1]
