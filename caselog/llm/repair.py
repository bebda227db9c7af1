"""Re-Pair grammars of token ids.

The most frequent pairs of neighbouring symbols are replaced by new symbols
(nonterminals), again and again, until no pair is frequent. A round replaces its most frequent pairs together, left to right;
pairs never cross the end of a document, so every document starts at a symbol
of its own and can be decoded alone.

A shard is stored as: the header, the rules (left, right), the length of every
rule's expansion, and for every document its id, first symbol and token count;
then the low 16 bits of the symbols, and one plane for each higher bit in use.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"RPAIR003"
RULES_PER_ROUND = 3072  # what is left over waits for the next round
LEAST_COUNT = 8       # of a pair that is replaced
DRAWERS = 1 << 20
TOGETHER = 1 << 18    # places, pairs or ids whose wide arrays are made together; what is kept of them is narrow
_HEAD = "<8sIIIIQ"  # magic, documents, rules, first nonterminal, symbols, tokens


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, document ends, rules, first nonterminal) of ids with document ends."""
    symbols, ends, n = ids.astype(np.uint32), ends[ends > 0], len(ids)
    base = int(symbols.max()) + 1 if n else 0
    # A replaced pair leaves its symbol at the left place; the right one is gone and stepped over. Place n stands
    # for none, beyond either end of a document.
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[ends - 1], before[ends], before[0] = n, n, n
    gone = np.zeros(n, dtype=bool)
    # Where a frequent pair may begin. Replacing makes no pair of old symbols more frequent,
    # so a pair once found rare is not looked at again; only pairs with a new symbol come in.
    live = after < n
    rules: list[np.ndarray] = []
    top = base
    while True:  # every round that finds a pair leaves fewer symbols
        at = _places(live)
        pair, drawer = _pairs(symbols, after, at)
        full = _often(drawer >> 4 if len(drawer) < DRAWERS >> 4 else drawer)  # few pairs are counted in fewer drawers
        live[at] = full
        at = at[full]
        pair = pair[full]  # each frees its longer one
        drawer = drawer[full]
        chosen = _frequent(pair)
        if not len(chosen):
            break
        at, rule = _matches(at, pair, drawer, chosen)
        del pair, drawer
        right = after[at]
        take = _apart(at, right)
        at, right, rule = at[take], right[take], rule[take]
        symbols[at] = rule.astype(np.uint32) + np.uint32(top)
        next_at = after[right]
        after[at], before[next_at] = next_at, at
        gone[right] = True
        live[right] = False
        live[before[at]] = True
        live[at] = next_at < n
        live[n] = False
        rules.append(chosen)
        top += len(chosen)
    left = ~gone
    grammar = np.concatenate(rules) if rules else np.zeros(0, dtype=np.uint64)
    table = np.stack([grammar >> np.uint64(32), grammar & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)
    place = np.cumsum(left, dtype=np.int32)
    return symbols[left], place[ends - 1].astype(np.int64), table, base


def _places(live: np.ndarray) -> np.ndarray:
    """The places that are live."""
    return np.concatenate([(np.flatnonzero(live[k:k + TOGETHER]) + k).astype(np.int32) for k in range(0, len(live), TOGETHER)])


def _pairs(symbols: np.ndarray, after: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that begin at the places `at`, and their drawers."""
    pair, drawer = np.empty(len(at), dtype=np.uint64), np.empty(len(at), dtype=np.int32)
    for k in range(0, len(at), TOGETHER):
        some = at[k:k + TOGETHER]
        made = symbols[some].astype(np.uint64)
        made <<= np.uint64(32)
        made |= symbols[after[some]]
        pair[k:k + TOGETHER], drawer[k:k + TOGETHER] = made, _drawer(made)
    return pair, drawer


def _often(drawer: np.ndarray) -> np.ndarray:
    """Whether each drawer comes up often enough to hold a frequent pair."""
    if not len(drawer):
        return np.zeros(0, dtype=bool)
    count = np.zeros(int(drawer.max()) + 1, dtype=np.int32)
    for k in range(0, len(drawer), TOGETHER):
        some = np.bincount(drawer[k:k + TOGETHER])
        count[:len(some)] += some.astype(np.int32)
    return (count >= LEAST_COUNT)[drawer]


def _drawer(pairs: np.ndarray) -> np.ndarray:
    """A place for each pair among `DRAWERS`."""
    return (pairs * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).view(np.int64)


def _frequent(pair: np.ndarray) -> np.ndarray:
    """The most frequent pairs, one per drawer."""
    full = np.sort(pair)
    if not len(full):
        return full
    first = np.flatnonzero(np.append(True, full[1:] != full[:-1]))
    count = np.diff(np.append(first, len(full)))
    often = count >= LEAST_COUNT
    value, count = full[first[often]], count[often]
    value = value[np.lexsort((value, -count))[:RULES_PER_ROUND]]
    # Of two pairs in one drawer the rarer waits for the next round.
    return value[np.sort(np.unique(_drawer(value), return_index=True)[1])]


def _matches(at: np.ndarray, pair: np.ndarray, drawer: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rising places `at` those where a chosen pair begins, and the pair's number."""
    number = np.zeros(DRAWERS, dtype=np.int16)  # of RULES_PER_ROUND; 0: none
    number[_drawer(chosen)] = np.arange(1, len(chosen) + 1)
    hits, rules = [], []
    for k in range(0, len(at), TOGETHER):
        found = number[drawer[k:k + TOGETHER]]
        some = np.flatnonzero(found != 0)
        rule = found[some] - 1
        hit = chosen[rule] == pair[k:k + TOGETHER][some]
        hits.append(at[k:k + TOGETHER][some[hit]])
        rules.append(rule[hit])
    return np.concatenate(hits), np.concatenate(rules)


def _apart(at: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which matches to replace, none overlapping: in a run of neighbouring ones every other one, from the left."""
    place = np.arange(len(at), dtype=np.int32)
    opens = np.append(True, at[1:] != right[:-1]) if len(at) else np.zeros(0, dtype=bool)
    place -= np.maximum.accumulate(place * opens)
    place &= 1
    return place == 0


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, start, length) by symbol; symbols below `base` stand for themselves."""
    flat, rule = np.arange(base, base + len(rules)), np.arange(len(rules))
    while (deep := flat >= base).any():  # a rule uses earlier symbols only
        runs = 1 + deep
        at = np.cumsum(runs) - runs
        found = np.repeat(flat, runs)
        inner = flat[deep] - base
        found[at[deep]], found[at[deep] + 1] = rules[inner, 0], rules[inner, 1]
        flat, rule = found, np.repeat(rule, runs)
    size = np.append(np.ones(base, dtype=np.int64), np.bincount(rule, minlength=len(rules)))
    ids = np.append(np.arange(base, dtype=np.uint32), flat.astype(np.uint32))
    return ids, np.concatenate([[0], np.cumsum(size)[:-1]]), size


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    size: list[int] = []
    for a, b in rules.tolist():
        size.append((size[a - base] if a >= base else 1) + (size[b - base] if b >= base else 1))
    return np.array(size, dtype=np.int64)


def expand(symbols: np.ndarray, grammar: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    ids, start, size = grammar
    found = [ids[:0]]
    for k in range(0, len(symbols), TOGETHER):
        some = symbols[k:k + TOGETHER]
        runs = size[some]
        ends = np.cumsum(runs)
        place = np.repeat(start[some] - (ends - runs), runs)
        place += np.arange(len(place))
        found.append(ids[place])
    return np.concatenate(found)


def pack(doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> bytes:
    """The bytes of a shard. `doc_ids` are signed 64-bit numbers, `counts` at least 1."""
    symbols, ends, rules, base = compress(ids, np.cumsum(counts))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.uint32) if len(ends) else np.zeros(0, np.uint32)
    lengths = expansion_lengths(rules, base)
    planes = [np.packbits((symbols >> np.uint32(k) & np.uint32(1)).astype(np.uint8)) for k in _high(base, len(rules))]
    return b"".join([
        struct.pack(_HEAD, MAGIC, len(doc_ids), len(rules), base, len(symbols), len(ids)),
        rules.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(),
        doc_ids.astype("<i8").tobytes(), starts.astype("<u4").tobytes(), counts.astype("<u4").tobytes(),
        symbols.astype("<u2").tobytes(), *[plane.tobytes() for plane in planes]])


def _high(base: int, rules: int) -> range:
    """The bits above 16 that symbols can have."""
    return range(16, max(base + rules - 1, 0).bit_length())


class Shard:
    """A stored shard; any document of it is decoded from its own symbols."""

    def __init__(self, data: bytes | memoryview):
        magic, docs, rules, self.base, symbols, self.tokens = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(_HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, dtype=kind, count=n, offset=at)
            at += found.nbytes
            return found

        self.rules = take("<u4", 2 * rules).reshape(-1, 2)
        self.lengths = take("<u4", rules)
        self.doc_ids, self.starts, self.counts = take("<i8", docs), take("<u4", docs), take("<u4", docs)
        self.symbols = take("<u2", symbols)
        for k in _high(self.base, rules):
            plane = np.unpackbits(take("u1", (symbols + 7) // 8), count=symbols)
            self.symbols = self.symbols | plane.astype(np.uint32) << np.uint32(k)
        self.grammar = expansions(self.rules, self.base)

    def document(self, number: int) -> np.ndarray:
        end = self.starts[number + 1] if number + 1 < len(self.starts) else len(self.symbols)
        return expand(self.symbols[self.starts[number]:end], self.grammar)

    def all(self) -> np.ndarray:
        return expand(self.symbols, self.grammar)
