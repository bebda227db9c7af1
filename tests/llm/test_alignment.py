import hashlib
from collections import Counter

import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from caselog.llm import alignment
from caselog.llm import units as u
from caselog.llm.queries import piece_model_path, tokenizer_path

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """Both token lists of a text walked side by side, byte by byte."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    bytes_a = u.byte_level(tokenizer_path(), True).tokens()

    def bytes_b(k):
        piece = model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(k) else piece.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a[k] for k in a) != whole or b"".join(map(bytes_b, b)) != whole:
            found.append((doc_id, 0, 0, [], []))
            continue
        owner_a = [k for k, i in enumerate(a) for _ in bytes_a[i]]
        owner_b = [k for k, i in enumerate(b) for _ in bytes_b(i)]
        links = sorted(set(zip(owner_a, owner_b, strict=True)))
        groups, first = [], (0, 0)
        for k in range(len(whole)):
            last = k + 1 == len(whole)
            if last or (owner_a[k] != owner_a[k + 1] and owner_b[k] != owner_b[k + 1]):
                groups.append((a[first[0]:owner_a[k] + 1], b[first[1]:owner_b[k] + 1]))
                first = (owner_a[k] + 1, owner_b[k] + 1)
        pairs = [(a[x], b[y]) for x, y in links]
        counts.update(pairs)
        found.append((doc_id, len(a), len(b), groups, pairs))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for doc_id, n_a, n_b, groups, pairs in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(pairs), sum(counts[q] == most[q[1]] for q in pairs),
                    sum(counts[q] for q in pairs), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def run(docs):
    found = alignment.aligned_documents(docs, tokenizer_path(), piece_model_path())
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_documents(documents):
    assert run(documents) == brute([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_many_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 3000)
    few = documents.limit(80)
    assert run(few) == brute([(r.doc_id, r.text) for r in few.select("doc_id", "text").collect()])


def test_edges(spark, edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()]
    assert run(edge_docs) == brute(rows)
    assert run(no_docs) == []
    odd = [(1, "a▁b"), (2, "x\r\ny  z\t\n"), (3, "<s> <|endoftext|> </s>"), (4, " "), (5, "\x00 é "), (6, None), (7, "")]
    assert run(spark.createDataFrame(odd, "doc_id long, text string")) == brute(odd)
    only_empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert run(only_empty) == brute([(1, None), (2, "")])


def test_a_block_alone():
    a = alignment._Side(u.byte_level(tokenizer_path(), True))
    b = alignment._Side(u.word_pieces(piece_model_path()))
    assert alignment.align(pa.array([], pa.string()), a, b)["n_a"].tolist() == []
    found = alignment.align(pa.array([None, "", "one two", "x▁"], pa.string()), a, b)
    assert found["n_links"].tolist()[:2] == [0, 0] and found["n_links"][2] >= 2 and found["n_a"][3] == 0
