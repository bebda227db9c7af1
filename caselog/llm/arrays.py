"""Words of many texts as numpy arrays, straight from Arrow's UTF-8 buffers.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which is the same in
UTF-8 bytes and in code points. Texts are worked through in blocks of bounded
size; only a single longer text makes a longer block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(*parts: np.ndarray | int) -> np.ndarray:
    """An order-dependent 64-bit hash of several 64-bit columns."""
    total = np.uint64(0)
    with np.errstate(over="ignore"):
        for part in parts:
            total = mix(np.asarray(total * _BASE + np.uint64(1)) + np.asarray(part, dtype=np.uint64))
    return total


@dataclass
class Block:
    """Rows `first`.. of a column: bytes, and the words of each row.

    Word k covers bytes `start[k]:end[k]` of `data`; row r holds the words
    `bound[r]:bound[r + 1]` and begins at byte `at[r]`.
    """

    first: int
    data: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bound: np.ndarray
    missing: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.at) - 1

    def hashes(self, lower: bool = True) -> np.ndarray:
        """One 64-bit hash per word; `lower` maps A-Z to a-z first."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        data = _LOWER[self.data] if lower else self.data
        value = data.astype(np.uint64)
        value += np.uint64(1)
        value[_BLANK[self.data]] = 0
        run = np.diff(np.append(self.start, len(data)))
        place = np.arange(self.start[0], len(data)) - np.repeat(self.start, run)
        power = np.ones(int(place.max()) + 1, dtype=np.uint64)
        power[1:] = _BASE
        np.multiply.accumulate(power, out=power)
        value = value[self.start[0]:] * power[place]
        return mix(np.add.reduceat(value, self.start - self.start[0]) + (self.end - self.start).astype(np.uint64))

    def prefixes(self, sizes: tuple[int, ...]) -> list[np.ndarray]:
        """Hashes of the first bytes of every word, lower-cased; shorter words are taken whole."""
        found, total = [], np.zeros(len(self.start), dtype=np.uint64)
        for k in range(max(sizes)):
            at = np.minimum(self.start + k, max(len(self.data) - 1, 0))
            byte = np.where(self.start + k < self.end, _LOWER[self.data[at]].astype(np.uint64) + np.uint64(1), 0)
            total = total * _BASE + byte.astype(np.uint64)
            if k + 1 in sizes:
                found.append(mix(total))
        return found

    def characters(self) -> np.ndarray:
        """Code points before each byte, and the total at the end."""
        heads = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=heads[1:])
        return heads


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string column in blocks of about `limit` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    if not len(column):
        return
    missing = column.is_null().to_numpy(zero_copy_only=False)
    if missing.any():
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield _block(row, data[offsets[row]:offsets[last]], offsets[row:last + 1] - offsets[row],
                     missing[row:last])
        row = last


def _block(first: int, data: np.ndarray, at: np.ndarray, missing: np.ndarray) -> Block:
    word = ~_BLANK[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] = word[inner]
    closes[inner - 1] = word[inner - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    return Block(first, data, at, start, end, np.searchsorted(start, at), missing)
