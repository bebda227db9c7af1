import random
import re

import pytest

from caselog.llm import components as rounds
from caselog.llm import near_dup
from caselog.llm.components import components
from caselog.llm.near_dup import near_duplicates, without_near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_force(rows, size, percent=80):
    """{doc_id: (set size, smallest reachable id)} of rows with distinct ids."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("size", [4, 5])
def test_documents(documents, size):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert result(near_duplicates(documents, size)) == brute_force(rows, size)


def test_groups_and_chains(spark):
    """Edited copies of a text, copies of copies, and edits near the limit on both sides."""
    random.seed(5)
    rows = []
    for group in range(4):
        base = [f"g{group}w{random.randrange(200)}" for _ in range(150)]
        for copy in range(60):
            words = list(base)
            for _ in range(random.choice([0, 1, 3, 5, 6, 8])):
                words[random.randrange(len(words))] = f"e{random.randrange(10**6)}"
            if copy % 3 == 0:
                words = words[:random.randrange(120, 150)]
            rows.append((len(rows) + 1, " ".join(words)))
        chain = list(base)
        for _ in range(15):
            chain[random.randrange(len(chain))] = f"c{random.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(chain)))
    random.shuffle(rows)
    found = result(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4))
    assert found == brute_force(rows, 4)


def test_edges(edge_docs, no_docs):
    rows = near_duplicates(edge_docs, 4).collect()
    assert len(rows) == edge_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert {c for i in (1, 2, 3) for _, c, _ in by[i]} == {1}
    assert [r.kept for r in rows if r.doc_id in (2, 3)] == [False] * 3
    for i in (4, 5, 6):
        assert by[i] == {(0, i, True)}
    assert by[7] == {(1, 7, True)}
    assert {c for _, c, _ in by[8] | by[9]} == {8}
    assert {(c, k) for _, c, k in by[None]} == {(None, True)}
    assert near_duplicates(no_docs, 4).collect() == []
    kept = without_near_duplicates(edge_docs, 4)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 8, 10, 11, 12]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (None, 1), (12, 11), (10, 12), (4, 6)]
    links += [(100, n) for n in range(101, 200)] + [(n, n + 1) for n in range(300, 340)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {n: found[n] for n in (1, 2, 3, 4, 6)} == dict.fromkeys((1, 2, 3, 4, 6), 1)
    assert found[9] == found[8] == found[7] == 7 and found[12] == found[11] == 10
    assert all(found[n] == 100 for n in range(100, 200)) and all(found[n] == 300 for n in range(300, 341))
    assert 5 not in found
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("sent", [0, 100_000])
def test_components_of_few_links_take_few_tasks(spark, monkeypatch, sent):
    """Each task costs the driver memory: rounds over a short table don't take one per shuffle partition."""
    links = [(100, n) for n in range(101, 200)] + [(n, n + 1) for n in range(300, 340)] + [(7, 7), (None, 3)]
    tasks, cut = [], rounds.cut
    monkeypatch.setattr(rounds, "SENT_ROWS", sent)  # joined with and without sending the smallest neighbours
    monkeypatch.setattr(rounds, "cut", lambda df, name: (tasks.append(df.rdd.getNumPartitions()), cut(df, name))[1])
    found = dict(components(spark.createDataFrame(links, "a long, b long").coalesce(1)).collect())
    assert found == {n: 100 if n < 300 else 300 for n in (*range(100, 200), *range(300, 341))}
    assert len(tasks) > 2 and set(tasks[1:]) == {1}


def test_links_are_gone_through_once(spark, monkeypatch):
    """Without new links the components that are known stay; new ones are joined to them, not to all links again."""
    calls = []
    monkeypatch.setattr(near_dup, "components", lambda links: (calls.append(links.count()), components(links))[1])
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:-1]), " ".join(base[1:]), " ".join(f"v{i}" for i in range(60))]
    found = result(near_duplicates(spark.createDataFrame([*enumerate(texts, 1)], "doc_id long, text string")))
    assert found == brute_force([*enumerate(texts, 1)], 5) and len(calls) == 1
    known = components(spark.createDataFrame([(1, n) for n in range(2, 30)] + [(50, 51)], "a long, b long"))
    checked = spark.createDataFrame([(29, 51, True), (1, 90, False), (60, 61, True)], "a long, b long, linked boolean")
    more = dict(near_dup._extended(known, checked).collect())
    assert more == dict.fromkeys((*range(1, 30), 50, 51), 1) | {60: 60, 61: 60} and calls[1] == 28 + 1 + 2
