"""Words, lines and hashes of many texts at once, as numpy passes over their UTF-8 bytes.

A batch of texts is one flat byte array with offsets, taken from Arrow without a copy. White space is the six
ASCII characters ``\\t \\n \\v \\f \\r`` and space; a word is a maximal run of anything else and never crosses a text.
Hashes are 64 bits wide and depend on bytes only, so they agree across tasks and executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 2 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash's multiplier, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 4096), _MULTIPLIER, np.uint64)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS[:n]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread 64-bit values evenly (xor-shift and multiply, wrapping)."""
    h = h + np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """A block of texts: ``data`` bytes, ``offsets`` per text, ``first`` its first row in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0) -> None:
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text each byte position belongs to."""
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def total(self, positions_mask: np.ndarray) -> np.ndarray:
        """Number of marked bytes per text."""
        sums = np.concatenate([[0], np.cumsum(positions_mask, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each maximal run of marked bytes; no run crosses a text."""
        cuts = self.offsets[:-1][self.sizes > 0]
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        before[cuts] = False
        after[cuts] = False
        after[-1] = False
        starts = np.flatnonzero(inside & ~before[:-1])
        ends = np.flatnonzero(inside & ~after[1:]) + 1
        return starts, ends

    def words(self, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~_SPACE[self.data if data is None else data])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each non-empty line (split at ``\\n`` only)."""
        return self.runs(self.data != 10)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Consecutive texts of about ``size`` bytes; a longer text is a block of its own; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    n, begin = len(column), column.offset
    if not n:
        return
    offsets = np.frombuffer(buffers[1], width)[begin : begin + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], at)
        at = to


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each run (runs ascend and do not overlap)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    base = np.cumsum(lengths) - lengths
    inside = np.arange(total) - np.repeat(base, lengths)
    at = inside + np.repeat(starts, lengths)
    terms = _BYTE_VALUES[data[at]] * powers(int(lengths.max()))[inside]
    return mix(np.add.reduceat(terms, base) + lengths.astype(np.uint64))


def windows(hashes: np.ndarray, owner: np.ndarray, k: int, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` consecutive words of one text, and where it starts among the words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[k - 1 :])
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        out = out * _MULTIPLIER + hashes[at + i]
    return mix(out, 1), at


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte kept."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def small_batches(df: DataFrame, size: str = "8m") -> DataFrame:
    """Have Arrow batches of the session hold about ``size`` bytes at most, so a batch of whole texts stays small."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df
