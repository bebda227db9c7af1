import itertools
import random
import re

from caselog.llm.decontaminate import LEAST, MASKS, REPLACED, WINDOW, decontaminated, overlaps

TOKEN = re.compile(r"[^\W_]+")


def brute_force(docs, items):
    """Pairs with an alignment that has a good window."""
    found = set()
    for d, text in docs:
        doc = TOKEN.findall((text or "").lower())
        for i, other in items:
            item = TOKEN.findall((other or "").lower())
            width = min(len(item), WINDOW)
            if len(item) < LEAST:
                continue
            allowed = REPLACED if len(item) >= WINDOW else 0
            for at in range(len(doc) - width + 1):
                if any(sum(a != b for a, b in zip(doc[at:at + width], item[k:k + width], strict=True)) <= allowed
                       for k in range(len(item) - width + 1)):
                    found.add((d, i))
                    break
    return found


def test_masks_miss_no_window():
    for replaced in itertools.combinations(range(WINDOW), REPLACED):
        assert any(not {at + k for k in mask} & set(replaced)
                   for mask in MASKS for at in range(WINDOW - mask[-1])), replaced


def test_against_brute_force(spark):
    random.seed(3)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: [random.choice(words) for _ in range(n)]
    items = [(i, text(random.choice([5, 8, 11, 13, 14, 40]))) for i in range(30)]
    docs = []
    for d in range(120):
        doc = text(random.choice([0, 6, 30, 80]))
        if d % 2:
            part = list(random.choice(items)[1])
            for _ in range(random.randrange(5)):
                part[random.randrange(len(part))] = "changed"
            at = random.randrange(len(doc) + 1)
            doc[at:at] = part
        docs.append((d, random.choice([" ", ", ", "\n"]).join(w.upper() if d % 3 else w for w in doc)))
    items = [(i, " ".join(t)) for i, t in items]
    found = overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame(items, "item_id long, text string")).collect()
    expected = brute_force(docs, items)
    assert len(expected) > 20
    assert {(r.doc_id, r.item_id) for r in found} == expected and len(found) == len(expected)
    for r in found:
        assert r.n_equal >= 8 and r.n_tokens >= 8 and r.doc_start >= 0


def test_documents(documents, spark, testdata):
    bench = spark.read.parquet(f"{testdata}/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert {(r.doc_id, r.item_id) for r in overlaps(documents, bench).collect()} == brute_force(docs, items)


def test_edges(edge_docs, no_docs, spark):
    items = spark.createDataFrame([
        (1, "THREE, four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", "x"), (2, None, "x"),
        (3, "", "x"), (4, "one two three", "x"), (None, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12", "x"),
        (1, "THREE, four five six seven eight nine ten eleven twelve thirteen fourteen fifteen", "x")],
        "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id) for r in overlaps(edge_docs, items).collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (None, 1), (8, None), (9, None)}
    kept = decontaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 7, 10, 11, 12]
    assert overlaps(no_docs, items).collect() == []
    assert overlaps(edge_docs, items.limit(0)).collect() == []
    assert decontaminated(edge_docs, items.limit(0)).count() == edge_docs.count()
