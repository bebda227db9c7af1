import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caselog.llm import packing as p
from caselog.llm.queries import tokenizer_path


def padding(size, window):
    return 0 if size & (size - 1) == 0 else window - size


@settings(deadline=None, max_examples=300)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(0, 40)), min_size=1, max_size=24), st.sampled_from([9, 12, 16]))
def test_cheapest_cuts_against_all_choices(steps, window):
    """The price of the cuts is the least one, found over all pairs of places."""
    at = np.cumsum([0, *[s for s, _ in steps]])
    cost = np.array([0, *[c for _, c in steps[:-1]], 0])
    best = [0] + [None] * len(steps)
    for j in range(1, len(at)):
        best[j] = min(best[i] + padding(int(at[j] - at[i]), window) + cost[j] + p.SEQUENCE_COST
                      for i in range(j) if at[j] - at[i] <= window)
    cuts = p.cheapest_cuts(at, cost, window)
    assert cuts[0] == 0 and cuts[-1] == at[-1]
    price = dict(zip(at.tolist(), cost.tolist(), strict=True))
    paid = sum(padding(b - a, window) + price[b] + p.SEQUENCE_COST for a, b in zip(cuts, cuts[1:], strict=False))
    assert all(0 < b - a <= window for a, b in zip(cuts, cuts[1:], strict=False)) and paid == best[-1]


def test_places_prefer_ends_of_documents_and_sentences():
    ids = np.array([0, 1, 0, 2, 0, 3, 0, 0] * 1000)          # 1: closes before an opening one, 2: opens, 3: a line break
    stops, opens = np.array([0, 1, 0, 2]), np.array([False, False, True, False])
    ends = np.array([4000, len(ids)])
    at, cost = p.places(ids, ends, stops, opens, 64)
    price = dict(zip(at.tolist(), cost.tolist(), strict=True))
    assert price[4000] == price[len(ids)] == price[0] == 0
    assert price[6] == p.SENTENCE_COST and 2 not in price     # a stop before an opening sign only
    assert all(k in price for k in range(len(ids) - 128, len(ids)))
    assert np.diff(at).max() <= p.STEP


def check(docs, window=2048):
    """Pieces of every row against plain encoding."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    sequences = p.packed(docs, tokenizer_path(), window=window).collect()
    rows = p.piece_rows(p.packed(docs, tokenizer_path(), window=window)).collect()
    expected = {}
    for r in docs.select("doc_id", "text").collect():
        expected.setdefault(r.doc_id, []).append([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    by_sequence, streams = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        streams.setdefault(r.doc_id, []).append(r)
    assert {s.sequence_id for s in sequences} == set(by_sequence) and len(sequences) == len(by_sequence)
    held = {s.sequence_id: np.frombuffer(s.ids, "<u4") for s in sequences}
    for number, pieces in by_sequence.items():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert sum(r.length for r in pieces) == len(held[number]) <= window
        for r in pieces:
            ids = held[number][r.offset:r.offset + r.length]
            assert zlib.crc32(ids.tobytes()) == r.ids_crc32
    for doc_id, pieces in streams.items():
        # Pieces in order of sequence give the rows of this doc_id one after the other.
        ids = np.concatenate([held[r.sequence_id][r.offset:r.offset + r.length]
                              for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))]).tolist()
        rest = sorted(expected[doc_id])
        found = []
        for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
            if r.start == 0:
                found.append(r.doc_tokens)
        parts = np.split(np.array(ids), np.cumsum(found)[:-1])
        assert sorted(x.tolist() for x in parts) == rest
    assert set(streams) == set(expected)
    return held


def test_documents(documents):
    held = check(documents)
    used = sum(map(len, held.values()))
    assert sum(padding(len(x), 2048) for x in held.values()) < 0.01 * used


def test_small_window_and_chains(documents, monkeypatch):
    monkeypatch.setattr(p, "CHAIN_TOKENS", 5000)
    check(documents.limit(60), 300)


def test_edges(edge_docs, no_docs):
    check(edge_docs)
    assert p.packed(no_docs, tokenizer_path()).collect() == []
    assert p.piece_rows(p.packed(no_docs, tokenizer_path())).collect() == []
