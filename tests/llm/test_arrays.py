import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from caselog.llm.arrays import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé你 \t\n\x0b\r\x1c.", max_size=12)), max_size=8)


@settings(deadline=None, max_examples=150)
@given(TEXT, st.integers(1, 20))
def test_words_of_blocks(texts, limit):
    found, seen = [], {}
    for block in blocks(pa.array(texts, pa.string()), limit):
        hashed, heads = block.hashes(), block.characters()
        begun = block.prefixes((1, 3))
        for r in range(block.rows):
            at = range(block.bound[r], block.bound[r + 1])
            found.append([bytes(block.data[block.start[k]:block.end[k]]).decode() for k in at])
            text = texts[block.first + r] or ""
            assert [heads[block.start[k]] - heads[block.at[r]] for k in at] == [m.start() for m in WORD.finditer(text)]
            for k, word in zip(at, found[-1], strict=True):
                low = re.sub("[A-Z]", lambda m: m.group().lower(), word)
                assert seen.setdefault(low, hashed[k]) == hashed[k]
                assert seen.setdefault(low.encode()[:3], begun[1][k]) == begun[1][k]
    assert found == [WORD.findall(t or "") for t in texts]
    words = [h for w, h in seen.items() if isinstance(w, str)]
    assert len(set(words)) == len(words)


def test_slices_and_large_strings():
    column = pa.chunked_array([pa.array(["a b", None, "c"]).slice(1), pa.array(["d e f"])])
    counts = [n for block in blocks(column) for n in np.diff(block.bound)]
    assert counts == [0, 1, 3]
    assert list(blocks(pa.array([], pa.string()))) == []
