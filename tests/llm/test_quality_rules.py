import math
import re
from collections import Counter

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselog.llm.quality_rules import THRESHOLD, base_counts, fit_ratio, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    often = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def grams(text, buckets):
    words = WORD.findall(text or "")
    found = []
    for k, w in enumerate(words):
        found.append(hashed_int(0, [w]) % buckets)
        found.append(hashed_int(1, [w[-2:]]) % buckets)
        if k + 1 < len(words):
            found.append(hashed_int(2, [w, words[k + 1]]) % buckets)
    return found


def hashed_int(first, parts):
    value = _int_hash(first, 42)
    for part in parts:
        value = xxhash.xxh64_intdigest(part.encode(), value)
    return value - (1 << 64) if value >= 1 << 63 else value


def _int_hash(x, seed):
    """XXH64 of the four little-endian bytes of a number."""
    return xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed)


def test_against_brute_force(spark, documents, testdata):
    labels = spark.read.parquet(f"{testdata}/sf0.001/labels.parquet").filter("quality = 1").select("doc_id").distinct()
    good = {r.doc_id for r in labels.collect()}
    docs = documents.select("doc_id", "text")
    ratio = fit_ratio(docs.join(F.broadcast(labels.withColumn("t", F.lit(True))), "doc_id", "left"), F.col("t"), 512)
    texts = {r.doc_id: r.text for r in docs.collect()}
    trusted, whole = Counter(), Counter()
    for i, text in texts.items():
        found = grams(text, 512)
        whole.update(found)
        if i in good:
            trusted.update(found)
    a, b = sum(trusted.values()) + 512, sum(whole.values()) + 512
    weights = [round(math.log((trusted[k] + 1) / a) - math.log((whole[k] + 1) / b), 6) for k in range(512)]
    assert all(abs(x - y) < 1e-6 for x, y in zip(weights, ratio.weights, strict=True))
    rows = quality(docs, ratio).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        found = grams(texts[r.doc_id], 512)
        score = sum(ratio.weights[k] for k in found) / len(found)
        assert r.base_failed == failed and abs(r.score - score) < 1e-5
        assert r.kept == (not failed and r.score >= THRESHOLD)


@settings(deadline=None, max_examples=20)
@given(st.lists(st.text(alphabet="ab#|é \n\t\x0b", max_size=60), min_size=1, max_size=30))
def test_base_counts(spark, texts):
    made = base_counts(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    for r in made.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id])


def test_edges(edge_docs, no_docs):
    ratio = fit_ratio(edge_docs, F.col("doc_id") == 1, 256)
    rows = quality(edge_docs, ratio).collect()
    texts = edge_docs.select("doc_id", "text").collect()
    key = lambda x: str(x)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows], key=key) == \
        sorted([(r.doc_id, *base(r.text)) for r in texts], key=key)
    assert all(r.base_failed and not r.kept and r.score == 0 for r in rows if r.n_words == 0)
    assert quality(no_docs, ratio).collect() == []
    assert set(fit_ratio(no_docs, F.lit(True), 16).weights) == {0.0}
    assert set(fit_ratio(edge_docs, F.lit(None).cast("boolean"), 16).weights) == {0.0}
