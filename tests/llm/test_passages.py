import random
import re

from pyspark.sql import functions as F

from caselog.llm.passages import STEP, STRETCH, repeated_passages, without_passages

WORD = re.compile(r"\S+")


def words(rng, n, name):
    return [f"{name}{rng.randrange(10**6)}" for _ in range(n)]


def test_pasted_passages_are_found_and_nothing_else(spark):
    """A passage pasted mid-line into several documents is marked in all but the first."""
    rng = random.Random(2)
    texts, planted = {}, {}
    passage = [words(rng, rng.randrange(51, 90), "p") for _ in range(8)]
    for d in range(60):
        host = words(rng, rng.randrange(30, 200), "h")
        at = rng.randrange(len(host))
        if d % 3 == 0:
            k = rng.randrange(len(passage))
            host[at:at] = [w.upper() if d % 2 else w for w in passage[k]]
            planted.setdefault(k, []).append(d)
        texts[d] = "".join(w + rng.choice([" ", " ", "  ", "\n"]) for w in host)
    rows = repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    marked = {d for docs in planted.values() for d in docs[1:]}
    assert {r.doc_id for r in rows} == marked
    for k, docs in planted.items():
        for d in docs[1:]:
            found = [texts[d][r.start:r.end] for r in rows if r.doc_id == d]
            cut = [w.lower() for part in found for w in WORD.findall(part)]
            assert len(cut) >= len(passage[k]) - 2 * (STEP - 1) and set(cut) <= set(passage[k])
            assert {r.kept_doc_id for r in rows if r.doc_id == d} == {docs[0]}


def test_whole_lines_and_copies(spark):
    rng = random.Random(4)
    lines = [" ".join(words(rng, n, "x")) for n in (5, 25, 40)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["other " + lines[0], lines[2], "end"])), (3, "\n".join(lines)),
            (4, lines[1] + "\n" + lines[1].upper())]
    rows = {}
    for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        rows.setdefault(r.doc_id, []).append((r.start, r.end))
    texts = dict(docs)
    assert [texts[2][a:b] for a, b in rows[2]] == [lines[2]]
    assert sum(b - a for a, b in rows[3]) >= len(lines[1]) + len(lines[2])
    assert 1 not in rows
    assert sum(b - a for a, b in rows[4]) >= 2 * len(lines[1])
    assert STRETCH == 20


def test_short_lines_and_copies_are_found(spark):
    """Repeated lines of under 20 words and copies of short texts go, whatever their length."""
    rng = random.Random(5)
    lines = [" ".join(words(rng, n, "s")) for n in (1, 2, 9, 19)]
    docs = [(1, "\n".join(["first text", *lines])), (2, "\n".join(x for k, line in enumerate(lines) for x in (line, f"own {k}"))), (3, "a short copy"),
            (4, "A  short copy"), (5, "\n".join(["twice here", "other", "twice here"]))]
    texts = dict(docs)
    found = {}
    for r in repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, []).append((texts[r.doc_id][r.start:r.end], r.kept_doc_id))
    assert sorted(found) == [2, 4, 5]
    assert sorted(found[2]) == sorted((line, 1) for line in lines)
    assert found[4] == [("A  short copy", 3)] and found[5] == [("twice here", 5)]


def test_shared_runs_are_found_to_both_ends(spark):
    """As brute force over all runs of 20 words: just those words are marked that an earlier text shares."""
    rng = random.Random(6)
    shared = [words(rng, n, "r") for n in (19, 20, 21, 27, 34, 51, 80)]
    texts = {}
    for d in range(40):
        host = words(rng, 60, "t")
        for k in rng.sample(range(len(shared)), 2):
            part = shared[k][rng.randrange(8):] if d % 4 == 3 else shared[k]
            at = rng.randrange(len(host))
            host[at:at] = part
        texts[d] = " ".join(host)
    seen, expected = {}, {}
    for d, text in texts.items():
        tokens = text.split()
        for k in range(len(tokens) - STRETCH + 1):
            run = tuple(tokens[k:k + STRETCH])
            if seen.setdefault(run, d) != d:
                expected.setdefault(d, set()).update(range(k, k + STRETCH))
    found = {}
    for r in repeated_passages(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        before = len(texts[r.doc_id][:r.start].split())
        found.setdefault(r.doc_id, set()).update(range(before, before + len(texts[r.doc_id][r.start:r.end].split())))
    assert expected and found == expected


def test_edges(edge_docs, no_docs):
    rows = repeated_passages(edge_docs).collect()
    assert {r.doc_id for r in rows} >= {2, 3, 9, None} and not {r.doc_id for r in rows} & {4, 5, 6, 7, 11, 12}
    text = "été 你好 \U0001f600 naïve\n\nline\nline"
    assert [(r.start, r.end, r.kept_doc_id) for r in rows if r.doc_id == 10] == [(len(text) - 4, len(text), 10)]
    clean = without_passages(edge_docs)
    assert clean.columns == [*[c for c in edge_docs.columns if c != "kept_spans"], "kept_spans"] and clean.count() == edge_docs.count()
    for r in clean.join(edge_docs.select("doc_id", F.col("text").alias("whole")).distinct(), "doc_id").collect():
        if r.whole is None:
            assert r.text is None and r.kept_spans is None
        else:
            assert r.text == "".join(r.whole[s.start:s.end] for s in r.kept_spans)
    kept = {r.doc_id: r.text for r in clean.collect() if r.doc_id}
    assert len(kept[2].split()) < 30 and len(kept[9].split()) < 40
    assert repeated_passages(no_docs).collect() == [] and without_passages(no_docs).collect() == []


def test_a_copy_is_one_row_however_long(spark):
    """Units of a large group are joined to spans where they stand, with and without other columns of the same text."""
    rng = random.Random(9)
    text = " ".join(words(rng, 400, "c"))
    docs = [(i, text if i % 3 == 0 else " ".join(words(rng, 30, f"o{i}x"))) for i in range(300)] + [(None, text), (3, text)]
    rows = repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    copies = [i for i in range(300) if i % 3 == 0][1:] + [None]
    assert sorted(((r.doc_id, r.start, r.end, r.kept_doc_id) for r in rows), key=repr) == sorted(
        ((i, 0, len(text), 0) for i in copies), key=repr)


def test_lines_of_any_length_are_units(spark):
    """As brute force over lines: all but the first occurrence, one-word lines and long ones too."""
    rng = random.Random(12)
    pool = [" ".join(words(rng, n, "l")) for n in (1, 1, 2, 5, 19, 20, 21, 60)]
    docs = {d: "\n".join(rng.choice(pool) if rng.random() < 0.5 else " ".join(words(rng, rng.randint(1, 8), f"u{d}x"))
                         for _ in range(9)) for d in range(30)}
    seen, expected = {}, {}
    for d, text in docs.items():
        at = 0
        for line in text.split("\n"):
            if line in seen:
                expected.setdefault(d, set()).update(range(at, at + len(line)))
            seen.setdefault(line, d)
            at += len(line) + 1
    found = {}
    for r in repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).update(k for k in range(r.start, r.end) if docs[r.doc_id][k] != "\n")
    assert found == expected
