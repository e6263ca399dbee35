"""Quality rules from compression: zstandard ratios of whole documents, of fixed chunks and of short parts.

Repetitive text compresses too well and noise hardly at all. What is usual depends on length (a short text cannot
share much with itself), so the limits are bands over the length in bytes. A document is judged as a whole, by its
chunks of fixed size and by parts of an eighth of that: a text that hides a long repetitive or incompressible passage
passes as a whole but not by these. What is left behind the last whole chunk is a chunk with the limits of its
length, from one part on; what is left behind the last whole part belongs to that part. So every byte of a text of
512 bytes or more is in a part, and shorter texts are judged as a whole only. A bad run is a row of bad parts: with
the given limits none may be longer than 1,024 bytes, so a bad passage of 2,047 bytes is found wherever it starts.

Defined results: a null or empty text has no words, fails the base rule and is not kept. Ratios of an empty text
are null. Rows with equal texts get equal results; any other columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from riskspark.llm.kept import kept_apart
from riskspark.llm.textbytes import Texts, blocks, hash_runs, small_batches, windows

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """Compressed size over size must lie in ``[low, high]`` for texts of at least ``from_bytes`` bytes."""

    from_bytes: int
    low: float
    high: float


# Whole documents, by length; the first band has no limits in effect.
DOCUMENT_BANDS = (
    Limits(0, 0.0, 9.0), Limits(100, 0.25, 1.20), Limits(200, 0.22, 1.02), Limits(500, 0.20, 0.92), Limits(1000, 0.17, 0.84),
    Limits(2000, 0.14, 0.78), Limits(5000, 0.11, 0.74), Limits(20000, 0.08, 0.72),
)
CHUNK_BYTES = 4096
CHUNK_LIMITS = Limits(CHUNK_BYTES, 0.10, 0.76)
# Texts of 512 to 1,023 bytes between the limits of prose (0.21 to 0.71 on the given tables) and of noise (from 0.85).
PART_BYTES = 512
PART_LIMITS = Limits(PART_BYTES, 0.15, 0.80)
# The rest behind the last whole chunk, by length.
TAIL_BANDS = (PART_LIMITS, Limits(1024, 0.13, 0.78), Limits(2048, 0.11, 0.77))
# Largest share of bad chunks, and of bad parts by bytes.
MAX_BAD_CHUNKS = 0.25
MAX_BAD_RUN = 1024
LEVEL = 3

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_bytes long, ratio double, n_chunks long, n_low_chunks long, n_high_chunks long, "
    "n_bad_bytes long, bad_run long, kept boolean"
)


def _earlier_equal(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks values that an earlier one of the same owner equals."""
    order = np.lexsort((values, owner))
    same = (values[order][1:] == values[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    return out


def _found_twice(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Marks values that occur at least twice in the same owner."""
    order = np.lexsort((values, owner))
    same = (values[order][1:] == values[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(values), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def base_counts(texts: Texts, window: int = 5) -> dict[str, np.ndarray]:
    """Word, symbol, line and repetition counts of every text."""
    n = len(texts)
    starts, ends = texts.words()
    owner = texts.owner(starts)
    in_word = np.zeros(len(texts.data) + 1, np.int8)
    in_word[starts] += 1
    in_word[ends[ends < len(in_word)]] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8).view(bool) if len(texts.data) else np.zeros(0, bool)
    characters = in_word & ((texts.data & 0xC0) != 0x80)

    line_starts, line_ends = texts.lines()
    if len(line_starts):
        has_word = np.add.reduceat(in_word.astype(np.int64), line_starts) > 0
        line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_owner = texts.owner(line_starts)
    repeated_line = _earlier_equal(hash_runs(texts.data, line_starts, line_ends), line_owner)

    hashes, at = windows(hash_runs(texts.data, starts, ends), owner, window, n)
    twice = at[_found_twice(hashes, owner[at])]
    covered = np.zeros(len(starts) + 1, np.int64)
    np.add.at(covered, twice, 1)
    np.add.at(covered, twice + window, -1)
    repeated_word = np.cumsum(covered[:-1]) > 0
    return {
        "n_words": np.bincount(owner, minlength=n),
        "word_chars": texts.total(characters),
        "n_symbols": texts.total(_SYMBOL[texts.data]),
        "n_dup_lines": np.bincount(line_owner[repeated_line], minlength=n),
        "n_repeat_words": np.bincount(owner[repeated_word], minlength=n),
    }


def _band(size: int, bands: tuple[Limits, ...]) -> Limits:
    return next(b for b in reversed(bands) if size >= b.from_bytes)


def ratios(
    text: bytes,
    compressor: zstandard.ZstdCompressor,
    chunk_bytes: int,
    limits: Limits,
    tail_bands: tuple[Limits, ...] = TAIL_BANDS,
    part_limits: Limits = PART_LIMITS,
) -> tuple[float | None, int, int, int, int, int]:
    """Ratio of the whole text; number of chunks, of too repetitive and of incompressible ones; bytes in bad parts and
    in the longest row of them."""
    size = len(text)
    if not text:
        return None, 0, 0, 0, 0, 0

    def ratio(start: int, end: int) -> float:
        return len(compressor.compress(text[start:end])) / (end - start)

    chunks = low = high = 0
    for start in range(0, size, chunk_bytes):
        end = min(start + chunk_bytes, size)
        if end - start < chunk_bytes and end - start < tail_bands[0].from_bytes:
            continue
        usual = limits if end - start == chunk_bytes else _band(end - start, tail_bands)
        found = ratio(start, end)
        chunks += 1
        low += found < usual.low
        high += found > usual.high

    bad = run = longest = 0
    part_bytes = part_limits.from_bytes
    whole_parts = size // part_bytes
    for i in range(whole_parts):
        start, end = i * part_bytes, (i + 1) * part_bytes if i < whole_parts - 1 else size
        if part_limits.low <= ratio(start, end) <= part_limits.high:
            run = 0
        else:
            bad += end - start
            run += end - start
            longest = max(longest, run)
    return ratio(0, size), chunks, low, high, bad, longest


def _score(rows: Iterator[pa.RecordBatch], keep: list[str], options: dict) -> Iterator[pa.RecordBatch]:
    compressor = zstandard.ZstdCompressor(level=options["level"])
    bands, chunk_bytes, limits, most = (options[k] for k in ("bands", "chunk_bytes", "chunk_limits", "max_bad_chunks"))
    tail_bands, part_limits, most_run = (options[k] for k in ("tail_bands", "part_limits", "max_bad_run"))
    for batch in rows:
        for texts in blocks(batch.column("__text")):
            out = base_counts(texts)
            sizes = texts.sizes
            found = [ratios(texts.text(i), compressor, chunk_bytes, limits, tail_bands, part_limits) for i in range(len(texts))]
            failed = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
            passed = [
                r is not None
                and (b := _band(int(s), bands)).low <= r <= b.high
                and low + high <= most * chunks
                and bad <= most * int(s)
                and run <= most_run
                for s, (r, chunks, low, high, bad, run) in zip(sizes, found, strict=True)
            ]
            columns = [batch.column(k).slice(texts.first, len(texts)) for k in keep]
            columns += [pa.array(out[k], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            columns += [pa.array(failed), pa.array(sizes, pa.int64()), pa.array([f[0] for f in found], pa.float64())]
            columns += [pa.array([f[i] for f in found], pa.int64()) for i in range(1, 6)]
            columns += [pa.array(~failed & np.array(passed, bool))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *options["names"]])


@kept_apart()
def compression_rules(
    docs: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    bands: tuple[Limits, ...] = DOCUMENT_BANDS,
    chunk_bytes: int = CHUNK_BYTES,
    chunk_limits: Limits = CHUNK_LIMITS,
    max_bad_chunks: float = MAX_BAD_CHUNKS,
    level: int = LEVEL,
    tail_bands: tuple[Limits, ...] = TAIL_BANDS,
    part_limits: Limits = PART_LIMITS,
    max_bad_run: int = MAX_BAD_RUN,
) -> DataFrame:
    """Counts, ratios and verdict per row of ``docs``.

    ``keep``: the columns to carry along (default: all). A kept column with the name of a result column gives way to
    the result. One pass over the texts, no shuffle; a task holds one Arrow batch.
    """
    names = [f.strip().split()[0] for f in FIELDS.split(",")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    options = {
        "bands": bands, "chunk_bytes": chunk_bytes, "chunk_limits": chunk_limits, "max_bad_chunks": max_bad_chunks,
        "level": level, "names": names, "tail_bands": tail_bands, "part_limits": part_limits, "max_bad_run": max_bad_run,
    }
    source = small_batches(docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text")))
    schema = source.drop("__text").schema
    for field in FIELDS.split(","):
        name, kind = field.split()
        schema = schema.add(name, kind)
    return source.mapInArrow(lambda rows: _score(rows, keep, options), schema)
