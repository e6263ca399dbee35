"""Byte-pair encoding and decoding of a SentencePiece model in vectorised merge rounds.

A text is cut before each run of spaces; no piece of such a model reaches across that cut, so the parts ("words",
with their leading spaces) encode independently and each distinct one only once. All new words of a batch are one
flat numpy array of symbols. A round finds, in every word at once, the adjacent pair with the best (smallest) rank,
the leftmost of equals, and merges it; the array is compacted and the next round begins, until no word has a pair
left. Where no better-ranked piece starts or ends with the merged piece, all its occurrences in a word merge in one
round, leftmost first, which gives what one at a time would.

Characters without a piece become their UTF-8 bytes' pieces. Special strings inside a text are ordinary text.

Defined results: null counts as empty; the empty text has the begin and end ids only and decodes to the empty text;
equal rows keep their number. Decoding takes any ids: control ids vanish, bytes that form no character become U+FFFD
one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskspark.llm.kept import kept_apart
from riskspark.llm.textbytes import small_batches

SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
# Bounds on what a worker remembers between batches (memory, not results).
REMEMBERED_WORDS = 200_000
REMEMBERED_LENGTH = 64
_NONE = np.int32(2**31 - 1)


class PieceCodec:
    """Tables of one model file, and the two directions."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bos, self.eos, self.unk = library.bos_id(), library.eos_id(), library.unk_id()
        self.byte_ids = np.zeros(256, np.uint32)
        self.bytes_of: list[bytes] = []
        self.by_text: dict[str, int] = {}
        self.is_byte = np.zeros(library.get_piece_size(), bool)
        ranked = []
        for i in range(library.get_piece_size()):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.is_byte[i] = True
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i) or library.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode() if library.is_unknown(i) else b"")
            else:
                self.by_text[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
                ranked.append((-library.get_score(i), i))
        # Equal scores share a rank: then the leftmost pair goes first, whatever its piece.
        self.rank = np.full(len(self.bytes_of) + 1, _NONE, np.int32)
        distinct = {s: r for r, s in enumerate(sorted({s for s, _ in ranked}))}
        for s, i in ranked:
            self.rank[i] = distinct[s]
        self._pairs()
        self.known: dict[str, bytes] = {}

    def _pairs(self) -> None:
        """Every pair of symbols that forms a piece, as sorted keys with the piece; which pieces may merge all at once."""
        pieces, size = self.by_text, len(self.bytes_of)
        # Single characters that are no piece still are symbols, but no pair that forms a piece can hold one.
        left, right, made = [], [], []
        best_affix = np.full(size + 1, _NONE, np.int64)
        for piece, i in pieces.items():
            for cut in range(1, len(piece)):
                a, b = pieces.get(piece[:cut]), pieces.get(piece[cut:])
                for affix in (a, b):
                    if affix is not None:
                        best_affix[affix] = min(best_affix[affix], self.rank[i])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        key = np.array(left, np.int64) * (size + 1) + np.array(right, np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_piece = np.append(key[order], np.int64(2**62)), np.append(np.array(made, np.int32)[order], 0)
        self.width = size + 1
        self.at_once = best_affix > self.rank  # no better piece (or equally good one) can grow from the merged one

    def _join(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair; no rank where the two form no piece."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.pair_key, key)
        hit = self.pair_key[at] == key
        piece = np.where(hit, self.pair_piece[at], 0)
        return np.where(hit, self.rank[piece], _NONE), piece

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of every word as little-endian 32-bit integers."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        text = "".join(words)
        character = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        alphabet, inverse = np.unique(character, return_inverse=True)
        # A character without a piece is a symbol of its own; it joins nothing.
        known = np.array([self.by_text.get(chr(c), self.width - 1) for c in alphabet], np.int32)
        symbol = known[inverse]
        begin = np.arange(len(symbol))  # first character of each symbol, for symbols without a piece
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, piece = self._join(symbol[:-1], symbol[1:]) if len(symbol) > 1 else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        rank, piece = np.append(rank, _NONE), np.append(piece, 0)
        rank[:-1][word[:-1] != word[1:]] = _NONE
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbol)))
            live = best != _NONE
            if not live.all():
                finished = np.repeat(~live, size)
                done.append((word[finished], symbol[finished], begin[finished]))
                keep = ~finished
                symbol, begin, word, rank, piece = symbol[keep], begin[keep], word[keep], rank[keep], piece[keep]
                best, size = best[live], size[live]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            # The leftmost of each word; further ones only if they may merge at once and do not overlap.
            leftmost = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            chosen = leftmost | self.at_once[piece[at]]
            at = at[chosen]
            chain = np.concatenate([[False], (at[1:] == at[:-1] + 1)])
            if chain.any():  # of overlapping pairs in a row, every second one from the left
                place = np.arange(len(at)) - np.maximum.accumulate(np.where(chain, 0, np.arange(len(at))))
                at = at[place % 2 == 0]
            symbol[at] = piece[at]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            changed = np.zeros(len(symbol), bool)
            changed[at] = True
            changed[at[at > 0] - 1] = True
            # the symbol before a merged one may itself have been absorbed: its absorber then is the one changed
            keep = ~gone
            changed[:-1] |= changed[1:] & gone[1:]
            symbol, begin, word, rank, piece, changed = (x[keep] for x in (symbol, begin, word, rank, piece, changed))
            redo = np.flatnonzero(changed)
            inner = redo[redo < len(symbol) - 1]
            new_rank, new_piece = self._join(symbol[inner], symbol[inner + 1])
            new_rank[word[inner] != word[inner + 1]] = _NONE
            rank[inner], piece[inner] = new_rank, new_piece
            rank[-1] = _NONE
        word, symbol, begin = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(begin, kind="stable")
        word, symbol, begin = word[order], symbol[order], begin[order]
        ids = symbol.astype(np.uint32)
        bare = np.flatnonzero(symbol == self.width - 1)
        if len(bare):  # characters without a piece, as bytes
            parts = [self.byte_ids[np.frombuffer(text[begin[i]].encode(), np.uint8)] for i in bare]
            count = np.ones(len(ids), np.int64)
            count[bare] = [len(p) for p in parts]
            word, ids = np.repeat(word, count), np.repeat(ids, count)
            place = np.cumsum(count) - count
            for i, part in zip(bare, parts, strict=True):
                ids[place[i] : place[i] + len(part)] = part
        flat = ids.astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of every text, with begin and end ids, as little-endian 32-bit integers."""
        cut = [_WORD.findall((SPACE + t.replace(" ", SPACE)) if t else "") for t in texts]
        new = {w for words in cut for w in words}.difference(self.known)
        found: dict[str, bytes] = {}
        ordered, at = sorted(new, key=len), 0
        while at < len(ordered):  # words of like length, a bounded number of characters at a time
            to, total = at, 0
            while to < len(ordered) and (to == at or total + len(ordered[to]) <= 1 << 19):
                total += len(ordered[to])
                to += 1
            found.update(zip(ordered[at:to], self.merge(ordered[at:to]), strict=True))
            at = to
        if len(self.known) + len(found) > REMEMBERED_WORDS:
            found.update((w, self.known[w]) for words in cut for w in words if w in self.known)
            self.known = {}
        self.known.update((w, ids) for w, ids in found.items() if len(w) <= REMEMBERED_LENGTH)
        known = self.known if all(len(w) <= REMEMBERED_LENGTH for w in found) else {**self.known, **found}
        bos, eos = (np.array([i], "<u4").tobytes() for i in (self.bos, self.eos))
        return [b"".join([bos, *map(known.__getitem__, words), eos]) for words in cut]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; the space put before a text goes."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.bytes_of.__getitem__, numbers))
        first = next((i for i in numbers if i not in (self.bos, self.eos)), None)
        if raw[:1] == b" " and first is not None and not self.is_byte[first] and first != self.unk:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return "".join(c if not "\udc80" <= c <= "\udcff" else "�" for c in raw.decode("utf-8", "surrogateescape"))


@lru_cache(maxsize=2)
def codec_of(path: str) -> PieceCodec:
    """One codec per model and Python worker: a later task finds the words of earlier ones."""
    return PieceCodec(path)


def _digests(rows: Iterator[pa.RecordBatch], keep: list[str], path: str, with_texts: bool) -> Iterator[pa.RecordBatch]:
    codec = codec_of(path)
    for batch in rows:
        ids = codec.encode(batch.column("__text").to_pylist())
        decoded = [codec.decode(i) for i in ids]
        columns = [batch.column(k) for k in keep]
        columns += [pa.array([len(i) // 4 for i in ids], pa.int64())]
        columns += [pa.array([hashlib.sha256(i).hexdigest() for i in ids])]
        columns += [pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded])]
        names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_texts:
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(i) // 4 for i in ids])]).astype(np.int32)
            columns += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(decoded)]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(columns, names=names)


@kept_apart()
def encode_documents(
    docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None, with_texts: bool = True
) -> DataFrame:
    """``docs`` (columns ``keep``, default all) with ``n_tokens, ids_sha256, decoded_sha256`` and, with ``with_texts``,
    the ``ids`` and ``decoded`` text themselves. Columns of these names give way. One pass, no shuffle.

    The model file must be at ``model_path`` on every executor.
    """
    extra = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_texts
    keep = [c for c in (docs.columns if keep is None else keep) if c not in extra]
    source = small_batches(docs.select(*[docs[c] for c in keep], docs[text].cast("string").alias("__text")))
    schema = source.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_texts:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return source.mapInArrow(lambda rows: _digests(rows, keep, model_path, with_texts), schema)
