"""Token ids of whole texts by remembered units, for a whole Arrow column at once.

A unit is a word with the blanks before it (or the blanks that end a text), a plain
slice of the column's bytes. Both kinds of tokenizer offered here never join a visible
character to a blank after it, so the ids of a text are those of its units in a row;
where that is not certain, the whole text is one unit. Units are told apart and looked up by
Arrow, new ones are encoded together, one on each line, and ids are gathered by numpy: no
work in Python is done per word. Tests compare the ids with those of plain encoding by the
tokenizer's own library.
"""

from __future__ import annotations

import json
import re
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from caselog.llm.arrays import _BLANK, blocks

BLOCK_BYTES = 4 << 20     # texts worked on at once; a single longer text makes a longer block
LINE_BYTES = 1 << 18      # new units encoded at once
MERGE_BYTES = 2000        # of them given to the library's model at once; longer texts are merged more slowly
MOST_UNITS = 400_000      # remembered; beyond, those that have not come up for longest are forgotten
LONG_UNIT = 64            # bytes; longer ones are not remembered

#: A text that holds one of these is one unit: blanks beyond ASCII are visible bytes
#: to the cuts but not to the pattern of a byte-level tokenizer, and word pieces may hold a carriage return.
WHOLE = r"[\r\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _bytes_of(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and bounds of a large string column."""
    bounds = np.frombuffer(units.buffers()[1], dtype=np.int64)[units.offset:units.offset + len(units) + 1]
    raw = units.buffers()[2]
    return (np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)), bounds


class Units:
    """`together` gives the ids of a text that begins with a line break, whose id is `line`; `alone` those of any text.

    `tokens` lists each id's bytes. Without `certain`, every text is one unit. With `kinds` (of `_kinds`) a unit also
    ends where an ASCII letter or digit and an ASCII sign meet, so a word is remembered once, whatever sign follows it.
    """

    def __init__(self, together: Callable[[str], list[int] | np.ndarray], alone: Callable[[str], list[int]], line: int,
                 tokens: Callable[[], list[bytes]], certain: bool, whole: str = WHOLE, kinds: np.ndarray | None = None):
        self.together, self.alone, self.line, self.tokens = together, alone, line, tokens
        self.certain, self.whole, self.sides = certain, whole, None
        if kinds is not None:
            self.sides = np.zeros(256, dtype=np.uint8)  # by byte: 1 a letter or digit, 2 a sign, 0 neither
            self.sides[:0x80] = np.array([0, 1, 1, 2])[kinds[:0x80]]
        self.forget()

    def forget(self) -> None:
        self.names = pa.array([], pa.large_string())
        self.ids = np.zeros(0, dtype="<u4")
        self.begin = self.size = self.age = np.zeros(0, dtype=np.int64)

    def _learnt(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new units, one after the other, and their numbers."""
        data, bounds = _bytes_of(units)
        blanks = np.append(0, np.cumsum(_BLANK[data[bounds[0]:bounds[-1]]]))[bounds - bounds[0]]
        first = data[bounds[:-1]]
        # A single blank or line break and a word: between line breaks the ids are the unit's own.
        plain = (np.diff(blanks) == 1) & (np.diff(bounds) > 1) & ((first == 0x20) | (first == 0x0A)) & self.certain
        if self.sides is not None:  # so are those of a part of a word
            plain |= (np.diff(blanks) == 0) & self.certain
        plain &= ~pc.match_substring_regex(units, self.whole).to_numpy(zero_copy_only=False)
        spaced = first[plain] != 0x0A
        lines = pc.binary_join_element_wise(
            pc.if_else(pa.array(spaced), pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())),
            units.filter(pa.array(plain)), pa.scalar("", pa.large_string()))
        size, parts = np.zeros(len(units), dtype=np.int64), []
        text, ends = _bytes_of(lines)
        at, sizes = 0, []
        while at < len(lines):
            last = max(at + 1, int(np.searchsorted(ends, ends[at] + LINE_BYTES, side="right")) - 1)
            ids = np.array(self.together(text[ends[at]:ends[last]].tobytes().decode()), dtype="<u4")
            marks = np.flatnonzero(ids == self.line)
            drop = spaced[at:last]  # the line break is no part of these
            sizes.append(np.diff(np.append(marks, len(ids))) - drop)
            parts.append(np.delete(ids, marks[drop]))
            at = last
        size[plain] = np.concatenate(sizes) if sizes else 0
        others = np.flatnonzero(~plain)
        if not len(others):
            return (np.concatenate(parts) if parts else self.ids[:0]), size
        found = [np.array(self.alone(u), dtype="<u4") for u in units.take(pa.array(others)).to_pylist()]
        size[others] = [len(f) for f in found]
        ids = np.empty(int(size.sum()), dtype="<u4")
        own = np.repeat(plain, size)
        ids[own] = np.concatenate(parts) if parts else ids[:0]
        ids[~own] = np.concatenate(found)
        return ids, size

    def _look_up(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, size): unit k has `ids[begin[k]:begin[k] + size[k]]`; new ones are learnt and remembered."""
        # Names are looked up among the units, which are fewer: the side looked up in is hashed anew each time.
        place = pc.fill_null(pc.index_in(self.names, units), -1).to_numpy()
        held = np.flatnonzero(place >= 0)
        at = np.full(len(units), -1, dtype=np.int64)
        at[place[held]] = held
        new = at < 0
        fresh = units.filter(pa.array(new))
        more, count = self._learnt(fresh)
        begin, size = self.begin[at] if len(self.begin) else np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        size[~new] = self.size[at[~new]]
        begin[new], size[new] = len(self.ids) + np.cumsum(count) - count, count
        ids = np.concatenate([self.ids, more])
        self.age += 1
        self.age[at[~new]] = 0
        short = np.diff(_bytes_of(fresh)[1]) <= LONG_UNIT
        self._remember(ids, pa.concat_arrays([self.names, fresh.filter(pa.array(short))]),
                       np.append(self.begin, begin[new][short]), np.append(self.size, count[short]),
                       np.append(self.age, np.zeros(int(short.sum()), dtype=np.int64)))
        return ids, begin, size

    def _remember(self, ids: np.ndarray, names: pa.Array, begin: np.ndarray, size: np.ndarray, age: np.ndarray) -> None:
        if len(names) > MOST_UNITS:
            keep = np.sort(np.argsort(age, kind="stable")[:MOST_UNITS // 2])
            names, begin, size, age = names.take(pa.array(keep)), begin[keep], size[keep], age[keep]
        ends = np.cumsum(size)
        place = np.repeat(begin - (ends - size), size)
        place += np.arange(len(place))
        self.names, self.ids, self.begin, self.size, self.age = names, ids[place], ends - size, size, age

    def encode(self, column: pa.Array | pa.ChunkedArray,
               limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds) of runs of rows: row r has the ids `bounds[r]:bounds[r + 1]` of its run.

        Null texts have no ids, nor have empty ones. A run has about `limit` bytes of text.
        """
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        alone = pc.fill_null(pc.match_substring_regex(column, self.whole), False).to_numpy(zero_copy_only=False)
        for block in blocks(column, limit):
            ends = block.end
            if self.sides is not None:
                side = self.sides[block.data]
                ends = np.append(ends, np.flatnonzero(side[1:] + side[:-1] == 3) + 1)
            if not self.certain:
                ends = ends[:0]
            elif alone[block.first:block.first + block.rows].any():
                row = np.searchsorted(block.at, ends, side="left") - 1
                ends = ends[~alone[block.first + row]]
            edge = np.zeros(len(block.data) + 1, dtype=bool)
            edge[block.at] = edge[ends] = True
            edges = np.flatnonzero(edge)
            coded = pa.LargeStringArray.from_buffers(
                len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(block.data))).dictionary_encode()
            ids, begin, size = self._look_up(coded.dictionary)
            code = coded.indices.to_numpy()
            count = size[code]
            ends = np.cumsum(count)
            place = np.repeat(begin[code] - (ends - count), count)
            place += np.arange(len(place))
            yield block.first, ids[place], np.append(0, ends)[np.searchsorted(edges, block.at)]


def shared(make: Callable[..., Units], path: str, **options) -> Units:
    """The one of this Python worker, which serves many tasks."""
    kept = vars(pa).setdefault("_remembered_units", {})
    name = (make.__name__, path, *sorted(options.items()))
    if name not in kept:
        kept[name] = make(path, **options)
    return kept[name]


# Fixed value: how byte-level tokenizers part a text before they merge.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_signs() -> dict[str, int]:
    """The visible sign by which a byte-level vocabulary shows each byte."""
    plainly = [b for span in ((0x21, 0x7F), (0xA1, 0xAD), (0xAE, 0x100)) for b in range(*span)]
    others = [b for b in range(256) if b not in plainly]
    return {chr(b): b for b in plainly} | {chr(256 + k): b for k, b in enumerate(others)}


def _merger(model: dict, special: set[str]):
    """The vocabulary and merges as an encoding that merges by rank, or None where ids do not follow the merges.

    It gives the same ids several times faster than the file's own library does word by word.
    """
    import tiktoken

    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    vocabulary, signs = model["vocab"], _byte_signs()
    if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or not merges:
        return None
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    words = [w for w in vocabulary if w not in special]
    if made != list(range(made[0], made[0] + len(made))) or len(words) != len(made) + 256 or any(
            w not in vocabulary or vocabulary[w] >= made[0] for w in signs):
        return None
    ranks = {bytes(signs[c] for c in w): vocabulary[w] for w in words}
    return tiktoken.Encoding("merges", pat_str=PARTS, mergeable_ranks=ranks, special_tokens={})


# Fixed value: characters that the library is asked about; words with others are encoded as they stand.
ASKED = 0x530  # Latin, Greek and Cyrillic letters


def _kinds(tokenizer) -> np.ndarray:
    """By character: 1, 2 or 3 if runs of letters, digits or signs go on over it; 0 where that is not certain.

    The library itself is asked how it parts each character from its like. An apostrophe may open a part of its own.
    """
    kinds = np.zeros(ASKED + 1, dtype=np.uint8)
    for kind, like in enumerate("a1#", start=1):
        asked = [c for c in map(chr, range(0x21, ASKED)) if c != "'" and not c.isspace()]
        parts = tokenizer.pre_tokenizer.pre_tokenize_str("\n".join(like + c + like for c in asked))
        whole = {begin for _, (begin, end) in parts if end - begin == 3}
        kinds[[ord(c) for k, c in enumerate(asked) if 4 * k in whole]] = kind
    return kinds


def _worded(tokenizer, built: dict, own: Callable[[str], list[int]], line: int, kinds: np.ndarray):
    """`together` of `Units` by the library's model alone, or None where a file asks for more.

    Words are parted by kinds of characters, as the library does it, and written in the signs of the vocabulary, so the
    library has neither to be asked for parts nor to keep track of places: it is given parts and merges them. Between them
    stands the sign of a byte that no text holds and no merge names, so nothing is merged over it, and its id tells where a
    part begins. The other words are encoded as they stand.
    """
    from tokenizers import Tokenizer

    model, signs = built["model"], {b: c for c, b in _byte_signs().items()}
    stop = signs[0xFF]  # in no UTF-8 text
    if (model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix")
            or model.get("end_of_word_suffix") or any(c not in model["vocab"] for c in signs.values())
            or any(stop in "".join(m) for m in model["merges"]) or built["truncation"] or built["padding"]
            or not all(t["special"] for t in built["added_tokens"])):
        return None
    parted = Tokenizer(tokenizer.model)
    written = "".join(stop if b == 0x0A else signs[b] for b in range(256))
    mark = model["vocab"][stop]

    def together(text: str) -> np.ndarray:
        signs = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        kind = kinds[np.minimum(signs, ASKED)]
        begins = np.flatnonzero(signs == 0x0A)
        blank = np.flatnonzero(signs == 0x20)
        kind[blank] = kind[blank + 1]  # the blank before a word is of its first part
        unsure = kind == 0
        unsure[begins] = False
        sure = ~np.logical_or.reduceat(unsure, begins)
        run = np.diff(np.append(begins, len(signs)))
        if not sure.all():
            mine = np.repeat(sure, run)
            others = np.array(own(signs[~mine].tobytes().decode("utf-32-le")), dtype="<u4")
            signs, kind = signs[mine], kind[mine]
        parts = np.flatnonzero((kind[1:] != kind[:-1]) & (signs[1:] != 0x0A) & (signs[:-1] != 0x0A)) + 1
        data = np.insert(signs, parts, 0x0A).tobytes().decode("utf-32-le").encode()
        lines = np.flatnonzero(signs == 0x0A)
        opens = np.insert(np.ones(len(lines), dtype=bool), np.searchsorted(lines, parts), False)
        stops = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x0A)
        cuts = np.unique(stops[np.searchsorted(stops, np.arange(0, len(data) and stops[-1] + 1, MERGE_BYTES))]).tolist()
        text = charmap_decode(data, "strict", written)[0]
        made = [parted.encode_batch_fast([text[a:b]], add_special_tokens=False)[0].ids for a, b in pairwise([*cuts, len(text)])]
        ids = np.array(list(chain.from_iterable(made)), dtype="<u4")
        at = np.flatnonzero(ids == mark)
        ids[at] = line
        ids = np.delete(ids, at[~opens])
        if sure.all():
            return ids
        count = np.zeros(len(sure), dtype=np.int64)
        for some, found in ((sure, ids), (~sure, others)):
            count[some] = np.diff(np.append(np.flatnonzero(found == line), len(found)))
        mine = np.repeat(sure, count)
        whole = np.empty(len(mine), dtype="<u4")
        whole[mine], whole[~mine] = ids, others
        return whole

    return together


def byte_level(path: str, plain: bool = False, by_rank: bool = True) -> Units:
    """A tokenizer file of the tokenizers library, without special tokens added.

    Special tokens inside a text are ordinary text if `plain`; a text that holds one is
    else left to that library as a whole, and so is all of a file whose ids do not follow its merges.
    Without `by_rank` every unit is encoded by the tokenizers library, with its model.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain
    built = json.loads(tokenizer.to_str())
    cut = built["pre_tokenizer"] or {}
    special = {t["content"] for t in built["added_tokens"]}
    certain = (cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
               and built["normalizer"] is None)
    merger = _merger(built["model"], special) if certain and by_rank else None
    names = re.compile("|".join(map(re.escape, special))) if special and not plain else None

    def own(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    def alone(text: str) -> list[int]:
        return own(text) if merger is None or (names is not None and names.search(text)) else merger.encode_ordinary(text)

    line = own("\n")
    certain = certain and len(line) == 1
    together, kinds = own if merger is None else merger.encode_ordinary, None
    if certain and not by_rank:
        kinds = _kinds(tokenizer)
        together = _worded(tokenizer, built, own, line[0], kinds) or own

    def tokens() -> list[bytes]:
        signs = _byte_signs()
        entries = [tokenizer.id_to_token(k) or "" for k in range(tokenizer.get_vocab_size())]
        return [e.encode() if e in special or cut.get("type") != "ByteLevel" else bytes(signs[c] for c in e) for e in entries]

    return Units(together, alone, line[0], tokens, certain, f"{WHOLE}|{names.pattern}" if names else WHOLE, kinds)


def word_pieces(path: str) -> Units:
    """A sentencepiece model over texts that begin with the blank which it would put there itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    blank = model.piece_to_id("▁")
    probe = [model.id_to_piece(i) for i in model.encode(" a  ﬁ\nb ")]
    certain = ("".join(probe) == "▁▁a▁▁ﬁ<0x0A>b▁"
               and not any(re.search(r"[^▁\s][▁ \t\n\x0b\x0c]", p) for p in pieces))

    def alone(text: str) -> list[int]:
        ids = model.encode(text.removeprefix(" "))
        # The blank that the model puts first is the text's own, or else goes again.
        return (ids or [blank]) if text.startswith(" ") else ids[1:] if ids[:1] == [blank] else ids

    def tokens() -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    return Units(alone, alone, model.piece_to_id("<0x0A>"), tokens, certain)
