import random
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselog.llm import repair
from caselog.llm.pieces import Pieces
from caselog.llm.queries import tokenizer_path
from caselog.llm.tokens import read_document, read_tokens, write_tokens


@pytest.fixture(scope="module")
def pieces():
    return Pieces(tokenizer_path())


def plain(pieces, text):
    return pieces.tokenizer.encode(text or "", add_special_tokens=False).ids


PART = st.sampled_from(["the", "The", "thatnd", "it's", "'s", "été", "你好", "12", "x1", "...", "###", "a.", "b,",
                        " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "\x1c", "\x85", "<|endoftext|>", "\U0001f600", "!"])


@settings(deadline=None, max_examples=400)
@given(st.lists(st.lists(PART, max_size=12).map("".join), min_size=1, max_size=4))
def test_pieces_encode_like_the_library(texts):
    made = Pieces.__new__(Pieces)
    made.__dict__.update(test_pieces_encode_like_the_library.pieces.__dict__)
    made.after, made.begun, made.again = {}, {}, set()
    assert [np.frombuffer(b, "<u4").tolist() for b in made.encode(texts)] == [plain(made, t) for t in texts]


@pytest.fixture(autouse=True, scope="module")
def _shared(pieces):
    test_pieces_encode_like_the_library.pieces = pieces


def test_repair_goes_on_until_no_pair_is_frequent():
    """A long passage in many documents becomes one symbol."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 50_000, 300)
    docs = [np.concatenate([rng.integers(0, 50_000, 40), passage, rng.integers(0, 50_000, 40)]) for _ in range(20)]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs])
    symbols, ends_after, rules, base = repair.compress(ids, ends)
    parts = np.split(symbols, ends_after[:-1])
    assert all(len(part) == 81 for part in parts)
    grammar = repair.expansions(rules, base)
    assert all((repair.expand(part, grammar) == doc).all() for part, doc in zip(parts, docs, strict=True))


def test_repair_looks_at_rare_pairs_once(monkeypatch):
    """Rounds after the first see pairs that may still be frequent, not all that are left."""
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 50_000, 64)
    docs = [np.concatenate([rng.integers(0, 50_000, 2000), passage]) for _ in range(30)]
    seen, drawer = [], repair._drawer
    monkeypatch.setattr(repair, "_drawer", lambda pairs: seen.append(len(pairs)) or drawer(pairs))
    symbols, *_ = repair.compress(np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs]))
    assert len(symbols) == 30 * 2001
    assert len(seen) > 9 and sum(seen[1:]) < seen[0] / 2


def test_rules_are_expanded_together(monkeypatch):
    """Not rule by rule: arrays are joined a few times, however many rules there are."""
    rng = np.random.default_rng(5)
    docs = [rng.integers(0, 90, 4000) for _ in range(12)]
    rules, base = repair.compress(np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs]))[2:]
    joins, join = [], np.concatenate
    monkeypatch.setattr(repair.np, "concatenate", lambda *a, **k: joins.append(1) or join(*a, **k))
    ids, start, size = repair.expansions(rules, base)
    assert len(rules) > 1000 > 9 * len(joins)
    for k, (a, b) in enumerate(rules.tolist()):
        parts = [ids[start[s]:start[s] + size[s]].tolist() for s in (base + k, a, b)]
        assert parts[0] == parts[1] + parts[2]


def test_a_shard_is_packed_and_read_in_narrow_arrays():
    """A grammar takes a bounded number of bytes an id beside the ids, and its pieces join to the same shard."""
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 50_000, 8) for _ in range(3000)]
    ids = np.concatenate([words[k] for k in rng.zipf(1.3, 1 << 17) % 3000]).astype(np.uint32)
    counts = np.full(len(ids) // 1024, 1024)
    tracemalloc.start()
    try:
        repair.compress(ids, np.cumsum(counts))
        assert tracemalloc.get_traced_memory()[1] < 80 * len(ids)
        shard = repair.Shard(repair.pack(np.arange(len(counts)), ids, counts))
    finally:
        tracemalloc.stop()
    assert (shard.all() == ids).all()
    assert (shard.document(1000) == ids[1000 * 1024:1001 * 1024]).all()


def test_pieces_give_the_same_grammar(monkeypatch):
    """However few places are looked at together, the rules and symbols are those of all at once."""
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 60, n) for n in rng.integers(1, 900, 60)]
    ids, ends = np.concatenate(docs).astype(np.uint32), np.cumsum([len(d) for d in docs])
    whole = repair.compress(ids, ends)
    data = repair.pack(np.arange(len(docs)), ids, np.array([len(d) for d in docs]))
    monkeypatch.setattr(repair, "TOGETHER", 37)
    parts = repair.compress(ids, ends)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    assert repair.Shard(data).all().tolist() == ids.tolist()


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.sampled_from([0, 1, 2, 3, 70_000]), min_size=1, max_size=60), max_size=12), st.integers(1, 8))
def test_repair_round_trip(docs, times):
    docs = docs * times
    if not docs:
        return
    ids = np.concatenate([np.array(d, dtype=np.uint32) for d in docs])
    counts = np.array([len(d) for d in docs])
    shard = repair.Shard(repair.pack(np.arange(len(docs)), ids, counts))
    assert shard.all().tolist() == ids.tolist()
    assert [shard.document(k).tolist() for k in range(len(docs))] == docs
    assert shard.lengths.tolist() == shard.grammar[2][shard.base:].tolist()


def test_repair_replaces_frequent_pairs():
    ids = np.tile(np.array([5, 6, 7, 8], dtype=np.uint32), 4000)
    data = repair.pack(np.array([1]), ids, np.array([len(ids)]))
    assert len(data) < len(ids) / 2
    assert repair.Shard(data).lengths.max() >= 4


def check(docs, order):
    """Rows of a store against plain encoding, documents in the given order."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    store = write_tokens(docs, tokenizer_path())
    found = sorted(tuple(r) for r in read_tokens(store).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    expected, start = [], 0
    for doc_id, text in order:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((start, doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert found == expected
    return store, tokenizer


def test_documents(documents):
    rows = sorted((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    store, tokenizer = check(documents, rows)
    place = random.Random(1).choice(store.index.collect()).asDict()
    first = sum(r.n_docs for r in store.index.collect() if (r.part, r.shard) < (place["part"], place["shard"]))
    assert read_document(store, place, 0).tolist() == [
        *tokenizer.encode(rows[first][1], add_special_tokens=False).ids, 0]


def test_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    store = write_tokens(edge_docs, tokenizer_path())
    found = sorted(read_tokens(store, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    assert [r.ids for r in found if r.doc_id in (4, 5)] == [[0], [0]]
    assert read_tokens(write_tokens(no_docs, tokenizer_path())).collect() == []
