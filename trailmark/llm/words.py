"""Words of many texts at once, as arrays of byte positions and hashes.

Texts arrive as Arrow columns. They are cut into blocks of whole texts, so that
the arrays of a task stay small whatever the size of its partition; only a
single text longer than a block makes a longer one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 4096
_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BYTES = np.arange(256)

#: Word bytes of ``[^\x20\x09-\x0D]+``.
PLAIN = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
LOWERED = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)
_FOLD = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 0x20, _BYTES).astype(np.uint8)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over the whole."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = pow(base, len(out), 1 << 64)
        out = np.concatenate([out, out * np.uint64(step)])
    return out[:n]


_tables: dict[str, np.ndarray] = {"up": _powers(_ODD, 1), "down": _powers(_ODD, 1)}


def _table(name: str, n: int) -> np.ndarray:
    """Powers of the base or of its inverse; kept from one block to the next."""
    if len(_tables[name]) < n:
        base = _ODD if name == "up" else pow(_ODD, -1, 1 << 64)
        _tables[name] = _powers(base, max(n, BLOCK_BYTES + 2))
    return _tables[name][:n]


#: A random number for each byte value, so that no pattern of bytes is special.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
#: The same with A-Z lower-cased.
LOWERED_VALUES = BYTE_VALUES[_FOLD]


class Sums:
    """Hashes of any slices of a sequence of 64-bit numbers, from prefix sums."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _table("up", len(values)), out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _table("down", len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * down[start])

    def hash_windows(self, length: int) -> np.ndarray:
        """Of all windows of ``length`` numbers, by first position."""
        n = max(0, len(self.sums) - length)
        down = _table("down", len(self.sums))[:n]
        return mix((self.sums[length : length + n] - self.sums[:n]) * down)


@dataclass
class Block:
    """Consecutive texts: their bytes, and where each begins (``len(rows) + 1`` offsets)."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n_rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


@dataclass
class Words:
    """Byte ranges of all words of a block; row ``r`` has words ``first[r]:first[r + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut an Arrow column of texts (null: empty) into blocks of at most ``size`` bytes or one text."""
    if not len(column):
        return
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        last = min(max(last, row + 1), row + BLOCK_ROWS, len(column))
        lo, hi = offsets[row], offsets[last]
        yield Block(row, data[lo:hi], offsets[row : last + 1] - lo)
        row = last


def find_words(block: Block, table: np.ndarray) -> Words:
    inside = table[block.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = block.offsets[:-1][np.diff(block.offsets) > 0]
    begins[edges] = inside[edges]
    ends[edges[1:] - 1] = inside[edges[1:] - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, block.offsets))


def hash_words(block: Block, words: Words, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``fold`` lower-cases A-Z first."""
    values = LOWERED_VALUES if fold else BYTE_VALUES
    return Sums(values[block.data]).hash(words.start, words.end)


def without_columns(names: list[str], results: list[str]) -> list[str]:
    """Input columns that a result does not replace (names differ by more than case)."""
    taken = {name.lower() for name in results}
    return [name for name in names if name.lower() not in taken]
