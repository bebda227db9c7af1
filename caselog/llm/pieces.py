"""Whole-text token ids, with the ids of recurring pieces remembered.

A byte-level BPE tokenizer cuts a text by a pattern before it merges, so the ids
of a text are those of its parts wherever the cut is certain: before a blank that
follows a visible character, around a single line break, and between letters and
the sign after them. Everything else, and any tokenizer of another build, is
encoded as it stands. A test compares both ways.
"""

from __future__ import annotations

import json

import numpy as np
import tokenizers
from tokenizers import Tokenizer

MOST_PIECES = 240_000  # remembered pieces; beyond, those that have not recurred are forgotten
KEPT_PIECES = 60_000   # at most, from one task of a worker to the next

_SIGNS = frozenset(",.;:!?")


def _bytes(ids) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


class Pieces:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.after: dict[str, bytes | None] = {}   # a chunk that follows a blank; None: no certain cut
        self.begun: dict[str, bytes | None] = {}   # a chunk that begins a text or a line
        self.again: set[str] = set()               # chunks that have recurred
        built = json.loads(self.tokenizer.to_str())
        cut = built["pre_tokenizer"] or {}
        self.certain = (
            cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
            and built["normalizer"] is None and len(self._encode("\n")) == 1
            and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in built["added_tokens"]))
        if self.certain:
            [self.break_id] = self._encode("\n")
            self.line_break = _bytes([self.break_id])
            self.signs = {c: _bytes(self._encode(c)) for c in _SIGNS}

    @classmethod
    def shared(cls, path: str) -> Pieces:
        """The one of this Python worker, which serves many tasks."""
        kept = vars(tokenizers).setdefault("_remembered_pieces", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def rest(self) -> None:
        """Between tasks keep only what has recurred: the worker may do other work next."""
        self.after = {c: self.after[c] for c, _ in zip(self.again, range(KEPT_PIECES), strict=False) if c in self.after}
        self.again = set()
        self.begun = {}

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        if not self.certain:
            return [_bytes(self._encode(t)) for t in texts]
        split = [t.split(" ") for t in texts]
        heads = [s.pop(0) for s in split]
        if len(self.begun) > MOST_PIECES:
            self.begun.clear()
        if len(self.after) > MOST_PIECES:
            self.after = {c: self.after[c] for c in self.again} if len(self.again) <= MOST_PIECES // 2 else {}
            self.again = set()
        wanted = set().union(*split)
        new = wanted.difference(self.after)
        self.again |= wanted - new
        self._learn(new, set(heads).difference(self.begun))
        out = []
        for text, head, chunks in zip(texts, heads, split, strict=True):
            try:
                out.append(b"".join([self.begun[head], *map(self.after.__getitem__, chunks)]))
            except TypeError:  # no certain cut somewhere
                out.append(_bytes(self._encode(text)))
        return out

    def _learn(self, chunks: set[str], heads: set[str]) -> None:
        """Remember new chunks: the plain ones first, then those that are put together from others."""
        after, begun = self.after, self.begun
        plain, ended, rest = [], [], []
        for c in chunks:
            if c.isalpha():
                plain.append(c)
            elif c[-1:] in self.signs and c[:-1].isalpha():
                ended.append(c)
            else:
                rest.append(c)
        plain += {c[:-1] for c in ended}.difference(after) - chunks
        # Lines inside a chunk, where every break has a visible character on both sides.
        lines = {c: c.split("\n") for c in [*rest, *heads]}
        sure = {c: all(x and not x[0].isspace() and not x[-1].isspace() for x in parts) for c, parts in lines.items()}
        first = {x for c in rest if sure[c] and len(lines[c]) > 1 for x in lines[c][:1]}.difference(after) - chunks
        later = {x for c in rest if sure[c] for x in lines[c][1:]} | {x for c in heads if sure[c] for x in lines[c]}
        later = later.difference(begun)
        if first:
            self._learn(first, set())
        self._plain([" " + c for c in plain], plain, after)
        alpha = [x for x in later if x.isalpha()]
        stems = {x[:-1] for x in later if x[-1] in self.signs and x[:-1].isalpha()}.difference(begun)
        alpha += stems - set(alpha)
        self._plain(alpha, alpha, begun)
        other = [x for x in later if x not in begun and not (x[-1] in self.signs and x[:-1] in begun)]
        whole = [c for c in rest if c and not c[-1].isspace() and (not sure[c] or len(lines[c]) == 1)]
        made = self.tokenizer.encode_batch_fast(other + [" " + c for c in whole], add_special_tokens=False)
        for x, found in zip(other, made, strict=False):
            begun[x] = _bytes(found.ids)
        for c, found in zip(whole, made[len(other):], strict=True):
            after[c] = _bytes(found.ids)
        for x in later:
            if x not in begun:
                begun[x] = begun[x[:-1]] + self.signs[x[-1]]
        for c in ended:
            after[c] = after[c[:-1]] + self.signs[c[-1]]
        for c in rest:
            if c not in after:
                parts = lines[c]
                after[c] = self.line_break.join([after[parts[0]], *[begun[x] for x in parts[1:]]]) if sure[c] else None
        for c in heads:
            if len(lines[c]) > 1 or not sure[c]:
                begun[c] = self.line_break.join([begun[x] for x in lines[c]]) if sure[c] else None

    def _plain(self, texts: list[str], names: list[str], into: dict) -> None:
        """Encode words together; a line break between them, with an id of its own, parts them."""
        if not texts:
            return
        [made] = self.tokenizer.encode_batch_fast(["\n".join(texts)], add_special_tokens=False)
        ids = np.array(made.ids, dtype="<u4")
        ends = np.append(np.flatnonzero(ids == self.break_id), len(ids)) * 4
        data, begin = ids.tobytes(), 0
        for name, end in zip(names, ends.tolist(), strict=True):
            into[name] = data[begin:end]
            begin = end + 4
