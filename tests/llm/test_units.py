import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselog.llm import units as u
from caselog.llm.queries import piece_model_path, tokenizer_path

PART = st.sampled_from(["the", "The", "thatnd", "it's", "'s", "été", "你好", "12", "x1", "...", "###", "a.", "b,", "½", "é",
                        " ", "  ", "\n", "\n\n", "\t", "\r\n", "\xa0", " ", "\x1c", "\x85", "\x0b", "▁", "<s>",
                        "<|endoftext|>", "\U0001f600", "!"])
TEXTS = st.lists(st.lists(PART, max_size=12).map("".join), min_size=1, max_size=4)


def ids_of(made, texts):
    found = [None] * len(texts)
    for first, ids, bounds in made.encode(pa.array(texts, pa.string())):
        for r in range(len(bounds) - 1):
            found[first + r] = ids[bounds[r]:bounds[r + 1]].tolist()
    return found


@pytest.mark.parametrize("plain,by_rank", [(False, True), (True, True), (False, False)])
def test_byte_level_like_the_library(plain, by_rank):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = plain
    made = u.byte_level(tokenizer_path(), plain, by_rank)
    assert made.certain

    @settings(deadline=None, max_examples=300)
    @given(TEXTS)
    def same(texts):
        made.forget()
        assert ids_of(made, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    same()


def test_word_pieces_like_the_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    made = u.word_pieces(piece_model_path())
    assert made.certain

    @settings(deadline=None, max_examples=300)
    @given(TEXTS)
    def same(texts):
        made.forget()
        texts = [t.replace("▁", "") for t in texts]  # not to be told from a blank
        found = ids_of(made, [" " + t if t else "" for t in texts])
        assert found == [model.encode(t) for t in texts]

    same()


def test_bytes_of_tokens():
    made = u.byte_level(tokenizer_path(), True)
    tokens, text = made.tokens(), "Été: 你好 \U0001f600 <|endoftext|>\n x"
    [ids] = ids_of(made, [text])
    assert b"".join(tokens[k] for k in ids) == text.encode()
    pieces = u.word_pieces(piece_model_path())
    tokens = pieces.tokens()
    [ids] = ids_of(pieces, [" " + text])
    assert b"".join(tokens[k] for k in ids) == (" " + text).encode()


def test_forgets_and_learns_again(monkeypatch):
    monkeypatch.setattr(u, "MOST_UNITS", 8)
    made, fresh = u.byte_level(tokenizer_path()), u.byte_level(tokenizer_path())
    texts = [" ".join(f"w{k % 13} v{k}," for k in range(n)) for n in (5, 40, 40, 3)]
    for text in texts:
        assert ids_of(made, [text]) == ids_of(fresh, [text])
    assert len(made.names) < 100


def test_null_and_empty():
    made = u.byte_level(tokenizer_path())
    assert ids_of(made, [None, "", "a"])[:2] == [[], []]
    assert ids_of(made, []) == []
    assert np.concatenate([i for _, i, _ in made.encode(pa.array(["a b", None], pa.string()))]).dtype == np.uint32


def test_words_parted_like_the_library():
    """Without ranks the library's model is given parts; every asked character parts words as the library does."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    made = u.byte_level(tokenizer_path(), by_rank=False)
    assert made.together.__name__ == "together"  # and not the library's whole encoding
    signs = [c for c in map(chr, range(0x21, 0x600)) if not c.isspace()]
    texts = [f"x a{c}a 1{c}1 #{c}# {c} a1{c}{c}b\n{c}s'{c}" for c in signs] + ["it's we'll o'clock 'tis ''s 1's #'s x\n's"]
    assert ids_of(made, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_remembered_once_whatever_sign_follows():
    from tokenizers import Tokenizer

    made = u.byte_level(tokenizer_path(), by_rank=False)
    signs = [",", ".", "!", "?", ";", ":", "###", "$$$", "&&&", ")", '"', "-x", "'s", "'", "#'s", ""]
    texts = ["A " + " ".join(f"thatnd{s}" for s in signs) + "\n(thatnd) é, 12, a1.5b\n\n x  ,y"]
    tokenizer = Tokenizer.from_file(tokenizer_path())
    assert ids_of(made, texts) == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert made.names.to_pylist().count(" thatnd") == 1
    assert sorted(n for n in made.names.to_pylist() if n.startswith(" thatnd")) == [" thatnd", " thatnd'", " thatnd's"]


def test_model_gets_words_in_short_runs(monkeypatch):
    """However the runs are cut, the ids are those of the whole text."""
    texts = [" ".join(f"w{k}x, été{k} naïve; o'clock \U0001f600." for k in range(300))] + ["", "\n", "'", "'tis ''s", "\U0001f600"]
    expected = ids_of(u.byte_level(tokenizer_path()), texts)
    for size in (1, 7, 100, 1 << 20):
        monkeypatch.setattr(u, "MERGE_BYTES", size)
        assert ids_of(u.byte_level(tokenizer_path(), by_rank=False), texts) == expected
