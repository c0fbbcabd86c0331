"""Words of whole batches of texts as arrays: places, documents and 64-bit hashes, without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Positions with hash values of their own; later ones are told apart by a factor.
PLACES = 64
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, (PLACES, 256), dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def byte_class(keep) -> np.ndarray:
    """A table of 256 truth values."""
    return np.array([bool(keep(b)) for b in range(256)])


#: Bytes of words that end at ASCII white space.
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words of ASCII digits, ASCII letters and everything beyond ASCII.
LETTERED = byte_class(lambda b: chr(b).isalnum() if b < 0x80 else True)
#: A-Z to a-z.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins; NULL is empty."""
    column = texts.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of some texts in order. ``first[d]`` is the number of words before text ``d``."""

    data: np.ndarray  # bytes, folded if asked
    begin: np.ndarray  # byte places
    end: np.ndarray
    first: np.ndarray
    rows: np.ndarray  # byte places where texts begin

    def __len__(self) -> int:
        return len(self.begin)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a sum of table values by place and byte, mixed."""
        if not len(self.begin):
            return np.zeros(0, np.uint64)
        size = self.end - self.begin
        ends = np.cumsum(size)
        starts = ends - size
        place = np.arange(ends[-1]) - np.repeat(starts, size)
        at = np.repeat(self.begin, size) + place
        values = _TABLE.ravel()[(place % PLACES) * 256 + self.data[at]]
        if size.max() > PLACES:
            values = values * (2 * (place // PLACES) + 1).astype(np.uint64)
        return mixed(np.add.reduceat(values, starts) + size.astype(np.uint64) * _MIX)


def words_of(texts: pa.Array, kind: np.ndarray, fold: bool = False) -> Words:
    """The maximal runs of bytes of a class in each text."""
    data, rows = raw(texts)
    if fold:
        data = LOWER[data]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(rows), np.int64), rows)
    inside = kind[data]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = rows[(rows > 0) & (rows < len(data))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, begin, end, np.searchsorted(begin, rows), rows)


def sequence_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive values (across texts as well: the caller drops those).

    A polynomial, put together from those of halves, so that the work grows with log n.
    """
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    have, total, block, size = 0, None, hashes, 1
    while True:
        if n & size:
            factor = np.uint64(pow(int(_MIX), have, 2**64))
            # the values of this block stand before those already taken
            total = block if total is None else block[: len(hashes) - have - size + 1] * factor + total[size:]
            have += size
        size *= 2
        if size > n:
            return mixed(total)
        block = block[: -size // 2] * np.uint64(pow(int(_MIX), size // 2, 2**64)) + block[size // 2 :]


def inner_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Truth per start of a run of ``n`` words: the run lies in one text."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))[: total - n + 1]
    return np.arange(total - n + 1) + n <= last


def slices(texts: pa.Array, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Cuts a column into stretches of about ``limit`` bytes (a longer text stands alone)."""
    _, rows = raw(texts)
    begin = 0
    while begin < len(texts):
        stop = int(np.searchsorted(rows, rows[begin] + limit, side="right")) - 1
        stop = min(max(stop, begin + 1), len(texts))
        yield begin, stop
        begin = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
