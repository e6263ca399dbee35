"""Alignment of two tokenizers' tokens of one text, in lockstep over all texts of a batch.

Tokenizer A is a byte-level vocabulary of the ``tokenizers`` library and reads a space and the text; tokenizer B is a
``sentencepiece`` model that puts the space itself. Both therefore spell the same bytes, and a token is the byte range
it spells. Where tokens of both end together the text is cut: the tokens between two cuts form a group, and the two tokens
that end at a cut are linked.

The merge works on lanes, stretches of at most ``LANE_BYTES`` bytes of one text. Where a lane begins, the two tokens to look
at are known (the first that end behind that byte), so a long text is many lanes. One state vector holds the A and the B
position of every lane. Each step compares the two ends of all lanes: equal ends emit a link and a cut and advance both,
else the one that ends first advances. Finished lanes are compacted away.

How often an id pair is linked is counted over all texts. Of two linked tokens one spells the end of the other, so the
two vocabularies fix which pairs can be linked at all, some 320,000 here: counts are an array of that many numbers, whatever
the size of the corpus, and only this array is collected and broadcast.

Both tokenizers start a token at a single space between other characters, so texts are cut there and each distinct part is
encoded once and remembered by the worker.

Scale: texts are encoded once; numbers of the links of each text are stored in the shared folder, counted per task, summed,
and scored against the counts in a second pass over the stored numbers. Only counts per task are shuffled.

Defined results: null and empty texts, and texts that either tokenizer does not spell byte by byte, have no tokens: zeros and
an empty digest column. Equal rows keep their number and each of them counts; a column among ``keep`` that has the name
of a result gives way.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.llm.textbytes import small_batches
from riskspark.session import scratch_path

LANE_BYTES = 1024
BLOCK_BYTES = 1 << 20
# A single space without white space next to it: both tokenizers begin a new token with it, whatever stands there.
_CUT = re.compile(r"(?<=\S) (?=\S)")
# Bounds on what a worker remembers between blocks (memory, not results).
REMEMBERED_WORDS = 200_000
REMEMBERED_LENGTH = 64


def _byte_of_character() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Two tokenizers, the bytes of their tokens, and the id pairs that can be linked."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        byte_of = _byte_of_character()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.spelled_a = [b""] * self.a.get_vocab_size()
        for entry, i in self.a.get_vocab().items():
            self.spelled_a[i] = entry.encode() if entry in special else bytes(byte_of[c] for c in entry)
        self.spelled_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.spelled_b.append(bytes([int(piece[3:5], 16)]))
            else:
                self.spelled_b.append(b"" if self.b.is_control(i) else piece.replace("▁", " ").encode())
        self.size_a, self.size_b = (np.array([len(x) for x in s], np.int64) for s in (self.spelled_a, self.spelled_b))
        self.keys = self._pairs()
        self.ids_a: dict[str, bytes] = {}
        self.ids_b: dict[str, bytes] = {}
        self.broken: set[str] = set()
        # Texts of "id" and what follows it: for A a comma, or a bar at the end of its group; for B a comma or semicolon.
        self.listed = [f"{i}{end}" for i in range(len(self.spelled_a)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.spelled_b)) for end in ",;"]

    def _pairs(self) -> np.ndarray:
        """Sorted keys of all id pairs of which one token spells the end of the other."""
        by_bytes: list[dict[bytes, list[int]]] = [{}, {}]
        for table, spelled in zip(by_bytes, (self.spelled_a, self.spelled_b), strict=True):
            for i, s in enumerate(spelled):
                table.setdefault(s, []).append(i)
        keys = set()
        for i, s in enumerate(self.spelled_a):
            keys.update(i * len(self.spelled_b) + j for at in range(len(s)) for j in by_bytes[1].get(s[at:], ()))
        for j, s in enumerate(self.spelled_b):
            keys.update(i * len(self.spelled_b) + j for at in range(len(s)) for i in by_bytes[0].get(s[at:], ()))
        return np.array(sorted(keys), np.int64)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of each linked pair among all that can be linked."""
        return np.searchsorted(self.keys, a * len(self.spelled_b) + b).astype(np.int32)

    def _parts(self, texts: list[str | None]) -> list[list[str]]:
        """Texts cut at every single space between other characters."""
        parts = [t.split(" ") if t else [] for t in texts]
        new = set().union(*parts).difference(self.ids_a)
        # Parts between spaces are what is wanted, unless white space stands at the end of one.
        unsafe = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        return [_CUT.split(t) if unsafe and not unsafe.isdisjoint(p) else p for t, p in zip(texts, parts, strict=True)]

    def _learn(self, parts: list[list[str]]) -> None:
        """Remember the ids of all parts; which of them are not spelled as they are."""
        if len(self.ids_a) > REMEMBERED_WORDS:
            self.ids_a, self.ids_b, self.broken = {}, {}, set()
        new = list(set().union(*parts).difference(self.ids_a))
        if not new:
            return
        wanted = [b" " + p.encode() for p in new]
        lengths, whole = np.fromiter(map(len, wanted), np.int64, len(wanted)), b"".join(wanted)
        found_a = [e.ids for e in self.a.encode_batch_fast([" " + p for p in new], add_special_tokens=False)]
        found_b = self.b.encode(new, num_threads=1)
        for known, spelled, size, found in ((self.ids_a, self.spelled_a, self.size_a, found_a), (self.ids_b, self.spelled_b, self.size_b, found_b)):
            flat = np.fromiter(chain.from_iterable(found), np.uint32)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
            raw, at = flat.tobytes(), (4 * ends).tolist()
            known.update(zip(new, [raw[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)], strict=True))
            spelt = np.diff(np.concatenate([[0], np.cumsum(size[flat])])[np.concatenate([[0], ends])])
            if (spelt != lengths).any() or b"".join(map(spelled.__getitem__, flat.tolist())) != whole:
                self.broken.update(p for p, w, ids in zip(new, wanted, found, strict=True) if b"".join(map(spelled.__getitem__, ids)) != w)

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[bytes]]:
        """Ids of A and of B of every text, as 32-bit integers; none where the tokens do not spell a space and the text."""
        parts = self._parts(texts)
        self._learn(parts)
        out = []
        for known, spelled in ((self.ids_a, self.spelled_a), (self.ids_b, self.spelled_b)):
            ids = [b"".join(map(known.__getitem__, p)) for p in parts]
            for i, p in enumerate(parts) if self.broken else ():
                if not self.broken.isdisjoint(p):
                    whole = b"".join(map(spelled.__getitem__, np.frombuffer(ids[i], np.uint32).tolist()))
                    if whole != b" " + texts[i].encode():
                        ids[i] = b""
            out.append(ids)
        for long in [p for p in self.ids_a if len(p) > REMEMBERED_LENGTH]:
            del self.ids_a[long], self.ids_b[long]
            self.broken.discard(long)
        one, two = ([i if j else b"" for i, j in zip(*pair, strict=True)] for pair in (out, out[::-1]))
        return one, two


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of A and B end together, in order. ``ends_*`` ascend; ``lanes`` are the bytes where lanes begin, and the end."""
    a, b = (np.searchsorted(e, lanes[:-1], side="right") for e in (ends_a, ends_b))
    stop_a, stop_b = (np.searchsorted(e, lanes[1:], side="right") for e in (ends_a, ends_b))
    links: list[tuple[np.ndarray, np.ndarray]] = []
    live = (a < stop_a) & (b < stop_b)
    while True:
        if not live.all():
            a, b, stop_a, stop_b = a[live], b[live], stop_a[live], stop_b[live]
        if not len(a):
            break
        end_a, end_b = ends_a[a], ends_b[b]
        together = np.flatnonzero(end_a == end_b)
        links.append((a[together], b[together]))
        a, b = a + (end_a <= end_b), b + (end_b <= end_a)
        live = (a < stop_a) & (b < stop_b)
    if not links:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Links never cross, so both sides ascend together.
    return np.sort(np.concatenate([x for x, _ in links])), np.sort(np.concatenate([y for _, y in links]))


class Aligned:
    """Texts of a block: ids of both tokenizers laid end to end, the links, and where texts begin in each of them."""

    def __init__(self, pair: Pair, texts: list[str | None]) -> None:
        ids_a, ids_b = pair.encode(texts)
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int64) for ids in (ids_a, ids_b))
        self.a, self.b = (np.frombuffer(b"".join(ids), np.uint32).astype(np.int64) for ids in (ids_a, ids_b))
        self.ends, ends_b = np.cumsum(pair.size_a[self.a]), np.cumsum(pair.size_b[self.b])
        begins = np.concatenate([[0], self.ends])[self.at_a]  # byte where each text begins; the last is the end
        lanes = np.concatenate([np.arange(x, y, LANE_BYTES) for x, y in zip(begins[:-1], begins[1:], strict=True)] + [begins[-1:]])
        self.link_a, self.link_b = lockstep(self.ends, ends_b, lanes)
        self.at_link = np.searchsorted(self.link_a, self.at_a)
        self.numbers = pair.number(self.a[self.link_a], self.b[self.link_b])

    def groups(self, pair: Pair) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text: ids of A, then of B, group by group."""
        in_a, in_b = np.arange(len(self.a)), np.arange(len(self.b))
        # A token of A stands behind all B tokens of earlier groups; one of B behind all A tokens up to its own group.
        group_a, group_b = np.searchsorted(self.link_a, in_a), np.searchsorted(self.link_b, in_b)
        before_b = np.concatenate([[0], self.link_b + 1])[group_a]
        behind_a = (self.link_a + 1)[group_b] if len(self.link_a) else in_b
        out = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.link_a], last_b[self.link_b] = 1, 1
        out[in_a + before_b] = 2 * self.a + last_a
        out[in_b + behind_a] = 2 * (self.b + len(pair.spelled_a)) + last_b
        parts = list(map(pair.listed.__getitem__, out.tolist()))
        cuts = (self.at_a + self.at_b).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


@lru_cache(maxsize=2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    block, size = [], 0
    for text in texts:
        length = len(text or "")
        if block and size + length > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(text)
        size += length
    if block:
        yield block


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))


def _align(rows: Iterator[pa.RecordBatch], keep: list[str], own: list[str], path_a: str, path_b: str, with_links: bool) -> Iterator[pa.RecordBatch]:
    pair = pair_of(path_a, path_b)
    text, numbers = own
    for batch in rows:
        begin = 0
        for block in _blocks(batch.column(text).to_pylist()):
            found = Aligned(pair, block)
            part = batch.slice(begin, len(block))
            begin += len(block)
            n_links = np.diff(found.at_link)
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found.groups(pair)]
            columns = [part.column(k) for k in keep]
            # Every cut ends one group and links the two tokens that end there.
            columns += [pa.array(n) for n in (np.diff(found.at_a), np.diff(found.at_b), n_links, n_links)]
            columns += [pa.array(digests, pa.string()), _lists(found.numbers, found.at_link)]
            names = [*keep, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", numbers]
            if with_links:
                of_link = np.repeat(np.arange(len(block)), n_links)
                begins = np.concatenate([[0], found.ends])[found.at_a]
                columns += [_lists(found.a, found.at_a), _lists(found.b, found.at_b)]
                columns += [_lists(found.link_a - found.at_a[of_link], found.at_link), _lists(found.link_b - found.at_b[of_link], found.at_link)]
                columns += [_lists(found.ends[found.link_a] - begins[of_link], found.at_link)]
                names += ["a_ids", "b_ids", "link_a", "link_b", "cuts"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _count(rows: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """How often each pair number occurs in a task."""
    total = np.zeros(size, np.int64)
    for batch in rows:
        total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["number", "links"])


def _score(rows: Iterator[pa.RecordBatch], keep: list[str], numbers: str, counts, best) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        column = batch.column(numbers)
        offsets = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        sums = [np.concatenate([[0], np.cumsum(of[flat])])[offsets] for of in (best.value, counts.value)]
        columns = [batch.column(k) for k in keep] + [pa.array(np.diff(s)) for s in sums]
        yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_best", "count_sum"])


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, with_links: bool = True) -> DataFrame:
    """``docs`` (columns ``keep``, default all) with ``n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` and, with
    ``with_links``, the ids ``a_ids`` and ``b_ids``, the linked places ``link_a`` and ``link_b`` in them, and the byte ``cuts``
    behind the links (the space before the text is byte 0).

    ``n_best`` counts the links whose pair is, over all texts, the most frequent of its B id (ties included); ``count_sum`` adds
    up how often the pair of each link is linked over all texts. Both files must be at their paths on every executor.
    """
    spark = docs.sparkSession
    found = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    listed = ["a_ids", "b_ids", "link_a", "link_b", "cuts"] * with_links
    results = [*found, "n_best", "count_sum", *listed]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results]
    own = ["text_", "numbers_"]
    while set(own) & {*keep, *results}:
        own = [f"{c}_" for c in own]
    source = small_batches(docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias(own[0])))
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType(source.schema.fields[:-1])
    for name in found[:4]:
        schema = schema.add(name, "long")
    schema = schema.add(found[4], "string").add(own[1], ints)
    for name in listed:
        schema = schema.add(name, ints)
    stored = scratch_path(spark, "alignment")
    source.mapInArrow(lambda rows: _align(rows, keep, own, path_a, path_b, with_links), schema).write.parquet(stored)
    links = spark.read.schema(schema).parquet(stored)

    pair = pair_of(path_a, path_b)
    size, width = len(pair.keys), len(pair.spelled_b)
    per_task = links.select(own[1]).mapInArrow(lambda rows: _count(rows, size), "number int, links long")
    # At most one row for each pair that the vocabularies allow.
    total = per_task.groupBy("number").agg(F.sum("links").alias("links")).toArrow()
    counts = np.zeros(size, np.int64)
    counts[total.column("number").to_numpy()] = total.column("links").to_numpy()
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, pair.keys % width, counts)
    best = counts == highest[pair.keys % width]
    shared = [spark.sparkContext.broadcast(x) for x in (counts, best.astype(np.int64))]
    kept = [*keep, *found, *listed]
    out = T.StructType([schema[c] for c in kept]).add("n_best", "long").add("count_sum", "long")
    return links.select(*kept, own[1]).mapInArrow(lambda rows: _score(rows, kept, own[1], *shared), out)
