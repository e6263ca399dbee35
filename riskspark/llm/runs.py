"""Periodic runs of words, by enumeration of maximal pairs.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical), at least
``max(min_length, min_exponent * q)`` words long, that no neighbouring word extends. In a run of ``n`` words the word
sequences that start at its first word and ``q`` words later agree for exactly ``n - q`` words, and the words on
their left differ: they are a maximal pair. The other way round, a maximal pair at distance ``d`` that agrees for
``l >= (min_exponent - 1) * d`` words spans ``l + d`` words of period ``d``, and nothing extends it. So maximal pairs that
are close enough for their length are runs as they stand; of the pairs of one stretch the one with the smallest distance is
its smallest period.

Maximal pairs come from the tree of LCP intervals, walked bottom-up. Suffixes of all texts of a block are sorted by prefix
doubling, as numpy passes over word numbers; only those whose first ``shortest`` words occur again in their text are
sorted on, no shorter pair can be a run. Each interval holds its positions in order and, as class lists, where in that
order the left word changes. Two children of an interval meet by looking up each position of the smaller one in the
larger one, within the distance its prefix allows, and stepping over lists of the same left word as a whole: every step
but the last finds a pair. Occurrences that close form one progression, so there are few lists to step over.

Words are maximal sequences without the six ASCII white space characters and are compared exactly.

One pass, no shuffle; a task holds one block of texts. Defined results: null, empty and blank texts have no words, no run
and the digests of the empty string; equal rows keep their number; a column among ``keep`` that has the name of a result
gives way.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskspark.llm.textbytes import small_batches

BLOCK_WORDS = 200_000
Run = tuple[int, int, int]  # first word, words, period


def _refine(labels: np.ndarray, open_: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order suffixes that agree on ``width`` words by ``width`` more; which of them still agree with another one.

    A label is the place of a suffix's group among all sorted suffixes, so that refined labels keep the order.
    """
    behind = np.minimum(open_ + width, len(labels) - 1)
    order = np.lexsort((labels[behind], labels[open_]))
    at, old, new = open_[order], labels[open_][order], labels[behind][order]
    first_of_old = np.concatenate([[True], old[1:] != old[:-1]])
    first_of_new = first_of_old | np.concatenate([[True], new[1:] != new[:-1]])
    places = np.arange(len(at))
    base = np.maximum.accumulate(np.where(first_of_old, places, 0))
    start = np.maximum.accumulate(np.where(first_of_new, places, 0))
    refined = labels.copy()
    refined[at] = old + (start - base)
    shared = ~first_of_new
    shared[:-1] |= ~first_of_new[1:]
    return refined, at[shared]


def _sorted_suffixes(words: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes whose first ``shortest`` words occur again, in order, and the words each shares with the one before.

    ``words`` ends every text with a number found nowhere else, so nothing agrees beyond the end of a text.
    """
    order = np.argsort(words, kind="stable")
    ranked = words[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    labels = np.empty(len(words), np.int64)
    labels[order] = np.maximum.accumulate(np.where(first, np.arange(len(words)), 0))
    shared = ~first
    shared[:-1] |= ~first[1:]
    levels, open_, width = [labels], order[shared], 1
    wanted = open_ if shortest == 1 else None
    while len(open_):
        labels, open_ = _refine(labels, open_, width)
        levels.append(labels)
        width *= 2
        if wanted is None and width <= shortest < 2 * width:
            wanted = open_
    if wanted is None or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    suffixes = wanted[np.argsort(labels[wanted], kind="stable")]
    left, right = suffixes[:-1].copy(), suffixes[1:].copy()
    agreed = np.zeros(len(left), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        same = np.flatnonzero(levels[level][left] == levels[level][right])
        for side in (agreed, left, right):
            side[same] += 1 << level
    return suffixes, np.concatenate([[0], agreed])


class _Interval:
    """Positions of an interval, ascending, and the heads: those whose left word is not that of the position before."""

    __slots__ = ("positions", "heads")

    def __init__(self, position: int) -> None:
        self.positions, self.heads = [position], [position]

    def pairs(self, x: int, left: list[int], reach: int) -> Iterator[tuple[int, int]]:
        """Pairs of ``x`` with positions at most ``reach`` away whose left word differs from that of ``x``."""
        positions, heads, own = self.positions, self.heads, left[x]
        at, size = bisect_left(positions, x - reach), len(positions)
        while at < size and positions[at] <= x + reach:
            y = positions[at]
            if left[y] != own:
                yield (x, y) if x < y else (y, x)
                at += 1
            else:
                head = bisect_right(heads, y)
                if head == len(heads):
                    return
                at = bisect_left(positions, heads[head], at)

    def add(self, x: int, left: list[int]) -> None:
        positions, heads = self.positions, self.heads
        at = bisect_left(positions, x)
        if at < len(positions):
            after = positions[at]
            place = bisect_left(heads, after)
            is_head = place < len(heads) and heads[place] == after
            if left[after] != left[x]:
                if not is_head:
                    heads.insert(place, after)
            elif is_head:
                del heads[place]
        positions.insert(at, x)
        if at == 0 or left[positions[at - 1]] != left[x]:
            insort(heads, x)


def _maximal_pairs(suffixes: np.ndarray, agreed: np.ndarray, left: list[int], shortest: int, exponent: int) -> Iterator[tuple[int, int, int]]:
    """``(first, second, words they share)`` of every maximal pair at most ``shared / (exponent - 1)`` words apart."""

    def join(a: _Interval, b: _Interval, shared: int) -> _Interval:
        if len(a.positions) < len(b.positions):
            a, b = b, a
        reach = shared // (exponent - 1)
        for x in b.positions:
            found.extend((i, j, shared) for i, j in a.pairs(x, left, reach))
        for x in b.positions:
            a.add(x, left)
        return a

    found: list[tuple[int, int, int]] = []
    edges = np.flatnonzero(agreed < shortest).tolist() + [len(suffixes)]
    for begin, end in zip(edges[:-1], edges[1:], strict=True):
        # Where no two positions are within reach of each other, the tree below has no pair to report.
        group = np.sort(suffixes[begin:end])
        if end - begin < 2 or np.diff(group).min() * (exponent - 1) > agreed[begin + 1 : end].max():
            continue
        above: list[tuple[int, _Interval]] = []
        current = _Interval(int(suffixes[begin]))
        for position, shared in zip(suffixes[begin + 1 : end].tolist(), agreed[begin + 1 : end].tolist(), strict=True):
            while above and above[-1][0] > shared:
                depth, interval = above.pop()
                current = join(interval, current, depth)
            if above and above[-1][0] == shared:
                current = join(above.pop()[1], current, shared)
            above.append((shared, current))
            current = _Interval(position)
        while above:
            depth, interval = above.pop()
            current = join(interval, current, depth)
        yield from found
        found.clear()


def runs_of(texts: list[list[bytes]], min_length: int = 24, min_exponent: int = 3) -> list[list[Run]]:
    """Runs of each text, given as its words, by first word, then period."""
    if min_exponent < 2:
        raise ValueError("runs repeat their period at least twice")
    shortest = max(1, min_length - min_length // min_exponent)
    numbers, offsets, fresh = [], [0], count()
    for words in texts:  # numbers of one text only: equal words of two texts are no match
        known: dict[bytes, int] = defaultdict(fresh.__next__)
        numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        numbers.append(np.array([next(fresh)], np.int64))
        offsets.append(offsets[-1] + len(words) + 1)
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    suffixes, agreed = _sorted_suffixes(flat, shortest)
    left = np.concatenate([[-1], flat[:-1]]).tolist() if len(suffixes) else []
    periods: dict[tuple[int, int], int] = {}
    for first, second, shared in _maximal_pairs(suffixes, agreed, left, shortest, min_exponent):
        period = second - first
        if shared + period >= min_length:
            stretch = (first, shared + period)
            periods[stretch] = min(period, periods.get(stretch, period))
    out: list[list[Run]] = [[] for _ in texts]
    for (start, length), period in periods.items():
        text = bisect_right(offsets, start) - 1
        out[text].append((start - offsets[text], length, period))
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length for its period; of equals the first, then the one with the smaller period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds beyond its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def _blocks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """Words of consecutive texts, about ``BLOCK_WORDS`` a block; a longer text is a block of its own."""
    block, size = [], 0
    for text in texts:
        words = (text or "").encode().split()  # bytes split at the six ASCII white space characters
        if block and size + len(words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(words)
        size += len(words)
    if block:
        yield block


_RESULT = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def _results(rows: Iterator[pa.RecordBatch], keep: list[str], text: str, min_length: int, min_exponent: int, with_texts: bool) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        table: list[list] = [[] for _ in range(9)]
        for block in _blocks(batch.column(text).to_pylist()):
            for words, runs in zip(block, runs_of(block, min_length, min_exponent), strict=True):
                start, length, period = strongest(runs) or (None, None, None)
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
                rest = b" ".join(collapse(words, runs))
                row = (
                    len(runs), start, length, period, None if period is None else 1000 * length // period,
                    hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest).hexdigest(),
                    runs if with_texts else None, rest.decode() if with_texts else None,
                )
                for column, value in zip(table, row, strict=True):
                    column.append(value)
        columns = [batch.column(k) for k in keep] + [pa.array(c, pa.int64()) for c in table[:5]] + [pa.array(c, pa.string()) for c in table[5:7]]
        names = [*keep, *_RESULT]
        if with_texts:
            run = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
            columns += [pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in c] for c in table[7]], pa.list_(run)), pa.array(table[8], pa.string())]
            names += ["runs", "collapsed"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def periodic_runs(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, min_length: int = 24, min_exponent: int = 3,
    with_texts: bool = True,
) -> DataFrame:
    """``docs`` (columns ``keep``, default all) with the number of runs, the strongest run (``start, length, period,
    exponent_milli``; null without a run), digests of all runs and of the text without repetitions and, with
    ``with_texts``, the ``runs`` and the ``collapsed`` text themselves.
    """
    extra = [*_RESULT, "runs", "collapsed"] if with_texts else _RESULT
    keep = [c for c in (docs.columns if keep is None else keep) if c not in extra]
    own = "text_"
    while own in keep:
        own += "_"
    source = small_batches(docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(own)))
    schema = T.StructType(source.schema.fields[:-1])
    for name in _RESULT[:5]:
        schema = schema.add(name, "long")
    schema = schema.add("runs_sha256", "string", False).add("collapsed_sha256", "string", False)
    if with_texts:
        run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
        schema = schema.add("runs", T.ArrayType(run)).add("collapsed", "string")
    return source.mapInArrow(lambda rows: _results(rows, keep, own, min_length, min_exponent, with_texts), schema)
