"""Vectorised views of text columns: many texts as one byte array with offsets.

Arrow string buffers are read as numpy arrays without making Python strings.
Texts are handled in slices of bounded size, so memory follows the slice (or
the longest single text), never the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE_BYTES = 1 << 20

#: Called when this worker turns to another operator: they drop large tables kept between tasks.
at_change: list[Callable[[], None]] = []

_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def let_go() -> None:
    """Drops the tables kept here and the memory Arrow holds unused: for operators with large tables of their own."""
    _powers.clear()
    pa.default_memory_pool().release_unused()


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, SLICE_BYTES + 4096)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        table = np.multiply.accumulate(factors)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply): spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Texts:
    """``data``: bytes of all texts; text i is data[offsets[i]:offsets[i+1]]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        self._sums: np.ndarray | None = None

    @classmethod
    def of(cls, texts: list[bytes | str | None]) -> Texts:
        raw = [t.encode() if isinstance(t, str) else t or b"" for t in texts]
        return cls(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64))

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self, flags: np.ndarray) -> np.ndarray:
        """Number of true flags (one per byte) in each text."""
        at = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return at[self.offsets[1:]] - at[self.offsets[:-1]]

    def range_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[s:e], the same wherever these bytes stand."""
        n = len(self.data)
        if self._sums is None:
            terms = (self.data.astype(np.uint64) + np.uint64(1)) * _power_table(_R, n)[:n]
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return mix((self._sums[ends] - self._sums[starts]) * _power_table(_R_INV, n + 1)[starts])

    def words(self) -> Words:
        """Maximal runs of bytes other than space and \\t..\\r."""
        space = _SPACE[self.data]
        return self.runs(~space)

    def runs(self, inside: np.ndarray) -> Words:
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return Words(none, none, np.zeros(len(self) + 1, np.int64))
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        before = np.empty(n, bool)
        before[0], before[1:] = True, ~inside[:-1]
        after = np.empty(n, bool)
        after[-1], after[:-1] = True, ~inside[1:]
        starts = np.flatnonzero(inside & (before | cut[:-1]))
        ends = np.flatnonzero(inside & (after | cut[1:])) + 1
        return Words(starts, ends, np.searchsorted(starts, self.offsets))


class Words:
    """Byte ranges of words; words of text i are number first[i]..first[i+1]."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.starts, self.ends, self.first = starts, ends, first

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_text)


def shingles(hashes: np.ndarray, words: Words, size: int, least: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows of ``size`` words within a text, and each one's text.

    least: a text of 1..size-1 words gives one shingle of all its words.
    """
    n = len(hashes)
    owner = words.owner()
    wins = max(0, n - size + 1)
    total = np.zeros(wins, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9FB21C651E98DF25) + hashes[j : j + wins]
    whole = owner[:wins] == owner[size - 1 : size - 1 + wins]
    values, owners = mix(total[whole]), owner[:wins][whole]
    if least:
        short = np.flatnonzero((words.per_text > 0) & (words.per_text < size))
        if len(short):
            extra = np.zeros(len(short), np.uint64)
            for j in range(size - 1):
                at = words.first[short] + j
                has = at < words.first[short + 1]
                extra[has] = extra[has] * np.uint64(0x9FB21C651E98DF25) + hashes[at[has]]
            values, owners = np.concatenate([values, mix(extra)]), np.concatenate([owners, short])
            order = np.argsort(owners, kind="stable")
            values, owners = values[order], owners[order]
    return values, owners


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(large), b"" if pa.types.is_large_binary(large) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(first row, end row, Texts) over a batch, of about ``most`` bytes each."""
    while at_change:
        at_change.pop()()
    data, at = string_buffers(batch.column(batch.schema.get_field_index(column)))
    row, rows = 0, len(at) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        end = min(end, rows)
        yield row, end, Texts(data[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end
