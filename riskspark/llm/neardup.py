"""N-gram Jaccard join with parity sketches.

A document is the set of its distinct word n-grams. In a parity sketch every n-gram flips one bit, so the sketches of
two sets differ in at most as many bits as the sets differ in members. A chunked sketch deals the n-grams to chunks by
hash and keeps the XOR of the 64-bit hashes of each chunk, so it differs in at most as many chunks. Sets with a
Jaccard similarity of at least ``p / q`` differ in at most ``t = (q - p) (|A| + |B|) / (q + p)`` members. With more than ``t`` chunks
they agree on a whole chunk (pigeonhole). The number of chunks follows the size, so sets meet in size bands: a set is
stored in its own band and in the next larger one, as the smaller partner.

Some chunks are shared by many sets that are not alike: those without any n-gram, or with n-grams of a passage found
everywhere only. There are ``spare`` more chunks than the pigeonhole needs, so alike sets agree on more than ``spare``.
A key that more than ``HOT`` sets hold is hot. A set with at most ``spare`` hot keys leaves them out: any partner still
agrees with it on one that is not hot. Sets with more keep all of theirs, so two of them still meet.

Equal sets are one node. Within a group of nodes that agree on a chunk not all pairs are made: first nodes are
compared with hubs of their groups only, another one in each round, and the components of these links are found; then, in groups that still
hold several components, all pairs across components are compared. A pair left out lies within one component, so no
link that joins anything is lost. Candidates pass a filter on parity sketches with four to eight bits for each member (Hamming
distance), then the exact test on the sets. Groups that are not hot hold their nodes' sketches folded to a quarter, as a node is in
many groups; the few pairs these let through meet the whole sketches. Hot groups hold whole sketches.

Scale: one text of each node is shuffled once, compressed. Its keys are made twice: first the keys alone are counted, and those
that several nodes hold are put in a Bloom filter of fixed size; then keys that the filter does not hold are dropped where they are
made, before anything is stored or shuffled with its node. The filter only saves work: a key it lets through wrongly has one
entry and goes when keys are counted with their nodes, and a corpus beyond its size shuffles more keys. Keys with equal groups are one
group. Groups are never collected whole; copies were merged before. All intermediate tables lie in the shared folder.

Defined results: a document without words (null or empty text) has no shingles and is linked with nothing; it is its
own component. A null identifier takes part: its component is the smallest identifier reachable, null if there is none.
Repeated identifiers share a component only through links of their texts. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.components import components
from riskspark.llm.textbytes import BLOCK_BYTES, Texts, blocks, hash_runs, lower_ascii, mix, small_batches, windows
from riskspark.session import scratch_path

SKETCH_WORDS = 12  # default length of a sketch: 64 bits each
HOT = 32  # sets that hold a key
HUB_ROUNDS = 2
PART_BYTES = 4 << 20  # sketches of a group's part, about
FILTER_BLOCKS, FILTER_WORDS = 16, 1 << 16  # 8 MB: 64-bit words, two bits for each key


@lru_cache(maxsize=8)
def _starts(num: int, den: int) -> np.ndarray:
    """Smallest set size of every band; a partner of a band's member is at most one band above."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den // num + 1)
    return np.array(out, np.int64)


def chunk_count(band: int, num: int, den: int) -> tuple[int, int]:
    """Number of chunks of a band and how many of them are spare."""
    most = int(_starts(num, den)[band + 1]) - 1
    need = 2 * most * (den - num) // (den + num) + 1
    if need == 1:
        return 1, 0
    least = int(_starts(num, den)[max(band - 1, 0)])
    empty = need * np.exp(-least / need)  # expected chunks without a member
    spare = 2 + need // 10 + int(np.ceil(2 * empty))
    return need + spare, spare


def shingle_sets(texts: Texts, k: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of every text; a text of fewer words has one, of them all."""
    data = lower_ascii(texts.data)
    starts, ends = texts.words(data)
    owner = texts.owner(starts)
    hashes = hash_runs(data, starts, ends)
    grams, at = windows(hashes, owner, k, len(texts))
    bounds = np.searchsorted(owner[at], np.arange(len(texts) + 1))
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        n = int(first[i + 1] - first[i])
        if 0 < n < k:
            out.append(windows(hashes[first[i] : first[i + 1]], np.zeros(n, np.int64), n, 1)[0])
        else:
            out.append(np.unique(grams[bounds[i] : bounds[i + 1]]))
    return out


def set_id(members: np.ndarray) -> bytes:
    """128 bits that depend on the members only."""
    return np.array([mix(members, 2).sum(dtype=np.uint64), mix(members, 3).sum(dtype=np.uint64)], "<u8").tobytes()


def parity_sketch(members: np.ndarray, n_words: int = SKETCH_WORDS) -> np.ndarray:
    """Each member flips one of ``64 n_words`` bits."""
    h = mix(members, 4)
    flips = np.bincount((h % np.uint64(64 * n_words)).astype(np.int64), minlength=64 * n_words) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


def own_sketch(members: np.ndarray) -> bytes:
    """Parity sketch with four to eight bits for each member: a power of two, so that sketches fold to a common length."""
    return parity_sketch(members, max(2, 4 << (len(members) - 1).bit_length() >> 6)).tobytes()


def folded(sketches: list[np.ndarray]) -> np.ndarray:
    """Sketches, XOR-folded to the length of the shortest."""
    words = min(map(len, sketches))
    return np.stack([np.bitwise_xor.reduce(s.reshape(-1, words), axis=0) for s in sketches])


def brief_sketch(sketch: bytes) -> bytes:
    """The sketch folded to a bit or two for each member."""
    words = np.frombuffer(sketch, np.uint64)
    return np.bitwise_xor.reduce(words.reshape(-1, max(2, len(words) // 4)), axis=0).tobytes()


def bands_of(size: int, num: int, den: int) -> tuple[int, int]:
    """The set's own band and the next."""
    own = int(np.searchsorted(_starts(num, den), size, side="right")) - 1
    return own, own + 1


def chunk_keys(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the sketch's chunks, in the set's own band and the next. The lowest bit tells own (1) from next (0)."""
    out = []
    bands = bands_of(len(members), num, den)
    for band in bands:
        chunks, spare = chunk_count(band, num, den)
        if chunks - spare == 1:  # only equal sets are alike there, and they are one node
            continue
        h = mix(members, 1000 + band)
        at = (h % np.uint64(chunks)).astype(np.int64)
        bits = mix(h, 5)
        order = np.argsort(at, kind="stable")
        used, begin = np.unique(at[order], return_index=True)
        value = np.zeros(chunks, np.uint64)
        value[used] = np.bitwise_xor.reduceat(bits[order], begin)
        place = np.arange(chunks, dtype=np.uint64) + np.uint64(band << 40)
        key = mix(value * np.uint64(0x9E3779B97F4A7C15) + mix(place, 6), 7)
        out.append((key & ~np.uint64(1)) | np.uint64(band == bands[0]))
    return np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64)


def _unpacked(column: list[bytes], block: int = BLOCK_BYTES) -> Iterator[Texts]:
    """Compressed texts as blocks of about ``block`` bytes; a longer text is a block of its own."""
    unpack, at = zstandard.ZstdDecompressor(), 0
    while at < len(column):
        to, size = at, 0
        while to < len(column) and (to == at or size + zstandard.frame_content_size(column[to]) <= block):
            size += zstandard.frame_content_size(column[to])
            to += 1
        texts = [unpack.decompress(x) for x in column[at:to]]
        yield Texts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), at)
        at = to


def _signatures(rows: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        for texts in blocks(batch.column("text")):
            sets = shingle_sets(texts, k)
            sketches = [own_sketch(s) if len(s) else None for s in sets]
            spare = [[chunk_count(b, num, den)[1] for b in bands_of(len(s), num, den)] if len(s) else [0, 0] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(texts.first, len(texts)) for c in ("id", "digest")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_id(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(sketches, pa.binary()),
                    pa.array([s if s is None else brief_sketch(s) for s in sketches], pa.binary()),
                    pa.array([x[0] for x in spare], pa.int32()),
                    pa.array([x[1] for x in spare], pa.int32()),
                ],
                names=["id", "digest", "n", "sid", "sketch", "brief", "spare_own", "spare_next"],
            )


def _packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, so that they take little room on their way to their nodes."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in rows:
        for texts in blocks(batch.column("text")):
            columns = [batch.column(c).slice(texts.first, len(texts)) for c in ("id", "digest")]
            packed = pa.array([pack.compress(texts.text(i)) for i in range(len(texts))], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, packed], names=["text_id", "text_digest", "packed"])


def _counted_keys(rows: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Chunk keys of a block of nodes, without the lowest bit; each at most twice, as only whether it is shared matters."""
    for batch in rows:
        for texts in _unpacked(batch.column("packed").to_pylist(), BLOCK_BYTES // 4):
            keys = np.sort(np.concatenate([chunk_keys(s, num, den) for s in shingle_sets(texts, k) if len(s)] or [np.zeros(0, np.int64)]) >> 1)
            third = np.concatenate([np.zeros(min(len(keys), 2), bool), keys[2:] == keys[:-2]])
            flat = keys[~third]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))], names=["keys"])


def _keys(rows: Iterator[pa.RecordBatch], k: int, num: int, den: int, held) -> Iterator[pa.RecordBatch]:
    """Chunk keys of the nodes that the filter ``held`` holds."""
    for batch in rows:
        for texts in _unpacked(batch.column("packed").to_pylist(), BLOCK_BYTES // 4):
            keys = [chunk_keys(s, num, den) if len(s) else np.zeros(0, np.int64) for s in shingle_sets(texts, k)]
            flat = np.concatenate(keys)
            word, mask = filter_place(flat >> 1)
            good = held.value[word] & mask == mask
            lengths = np.diff(np.concatenate([[0], np.cumsum(good)])[np.cumsum([0, *map(len, keys)])])
            flat = flat[good]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(texts.first, len(texts)), lists], names=["node", "keys"])


def filter_place(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter that a key belongs to, and its two bits there. ``filter_columns`` is the same on columns."""
    word = (key & (FILTER_BLOCKS * FILTER_WORDS - 1)).astype(np.int64)
    mask = (np.int64(1) << (key >> 24 & 63)) | (np.int64(1) << (key >> 32 & 63))
    return word, mask


def filter_columns() -> tuple[str, str]:
    one = "shiftleft(1L, CAST(shiftright(key, {}) & 63 AS INT))"
    return f"key & {FILTER_BLOCKS * FILTER_WORDS - 1} AS word", f"{one.format(24)} | {one.format(32)} AS mask"


def _filter_blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the filter, packed in blocks; a block lies in one task."""
    blocks: dict[int, np.ndarray] = {}
    for batch in rows:
        word, mask = (batch.column(c).to_numpy() for c in ("word", "mask"))
        for block in np.unique(word // FILTER_WORDS).tolist():
            at = word // FILTER_WORDS == block
            blocks.setdefault(block, np.zeros(FILTER_WORDS, np.int64))[word[at] % FILTER_WORDS] = mask[at]
    for block, words in blocks.items():
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([words.tobytes()])], names=["block", "words"])


def _filter(keys: DataFrame) -> np.ndarray:
    """Bloom filter of the keys that occur more than once in ``keys``; always the same size, whatever the number of keys."""
    # Nearly all keys are distinct, so they are not aggregated before they are dealt out.
    shared = keys.repartition("key").groupBy("key").count().where("count > 1")
    words = shared.selectExpr(*filter_columns()).groupBy("word").agg(F.expr("bit_or(mask)").alias("mask"))
    blocks = words.repartition(F.expr(f"word div {FILTER_WORDS}")).mapInArrow(_filter_blocks, "block long, words binary")
    out = np.zeros(FILTER_BLOCKS * FILTER_WORDS, np.int64)
    for block, packed in blocks.collect():
        out[block * FILTER_WORDS : (block + 1) * FILTER_WORDS] = np.frombuffer(packed, np.int64)
    return out


def _shared_keys(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``(key, entry)`` of all keys that several nodes may hold, stored. A key is without its lowest bit; that bit (own band or
    not) joins the node in the entry."""
    small = small_batches(texts, "4m")
    counted = small.mapInArrow(lambda rows: _counted_keys(rows, k, num, den), "keys array<long>")
    held = texts.sparkSession.sparkContext.broadcast(_filter(counted.select(F.explode("keys").alias("key"))))
    keyed = small.mapInArrow(lambda rows: _keys(rows, k, num, den, held), "node long, keys array<long>")
    index = keyed.select("node", F.explode("keys").alias("key")).selectExpr("shiftright(key, 1) AS key", "node * 2 + (key & 1) AS entry")
    index = _stored(index, "keys")
    held.destroy()  # not needed again: the table is in the shared folder
    return index


def _may_link(n_a: np.ndarray, n_b: np.ndarray, a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sizes and the Hamming distance of the sketches allow the similarity."""
    distance = np.bitwise_count(a ^ b).sum(-1)
    return (distance * (den + num) <= (den - num) * (n_a + n_b)) & (np.minimum(n_a, n_b) * den >= np.maximum(n_a, n_b) * num)


def _sketches(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _near_by_sketch(rows: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs that may link."""
    for batch in rows:
        n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
        pairs = zip(_sketches(batch.column("s_a")), _sketches(batch.column("s_b")), strict=True)
        good = [bool(_may_link(n_a[i], n_b[i], *folded(pair), num, den)) for i, pair in enumerate(pairs)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _near_in_group(rows: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of two parts of a group (or of a part with itself) that may link, lie in different components and not both
    in their next band."""
    for batch in rows:
        low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
        for i, group in enumerate(batch.column("m")):
            part, node, root, own, n = (
                group.values.field(c).to_numpy(zero_copy_only=False) for c in ("part", "node", "root", "own", "n")
            )
            sketch = folded(_sketches(group.values.field("held")))
            others = np.arange(len(node)) if low[i] == high[i] else np.flatnonzero(part == high[i])
            a, b = [], []
            for x in range(len(node)) if low[i] == high[i] else np.flatnonzero(part == low[i]):
                at = others[(root[others] != root[x]) & (own[others] | own[x])]
                if low[i] == high[i]:
                    at = at[at > x]
                at = at[_may_link(n[x], n[at], sketch[x], sketch[at], num, den)]
                a.append(np.minimum(node[x], node[at]))
                b.append(np.maximum(node[x], node[at]))
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def _linked(rows: Iterator[pa.RecordBatch], k: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs with ``den * |A and B| >= num * |A or B|``, a bounded number of bytes of text at a time."""
    for batch in rows:
        a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
        at = 0
        while at < len(a):
            texts, size, to = {}, 0, at
            while to < len(a) and (to == at or size <= 4 * BLOCK_BYTES):
                for node, text in ((a[to], x[to]), (b[to], y[to])):
                    if node not in texts:
                        texts[node] = text
                        size += zstandard.frame_content_size(text)
                to += 1
            found = [s for block in _unpacked(list(texts.values())) for s in shingle_sets(block, k)]
            sets = dict(zip(texts, found, strict=True))
            good = []
            for i in range(at, to):
                one, two = sets[a[i]], sets[b[i]]
                both = np.sort(np.concatenate([one, two]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(den * common >= num * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).slice(at, to - at).filter(pa.array(good, pa.bool_()))
            at = to


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _verify(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The distinct pairs ``(a, b)`` of nodes that link."""
    for side in ("a", "b"):
        pairs = pairs.join(sketches.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)
    pairs = pairs.mapInArrow(lambda rows: _near_by_sketch(rows, num, den), "a long, b long")
    # Stored, pairs have a known size, by which Spark chooses how they meet the texts.
    pairs = _stored(pairs, "pairs")
    one, two = (
        pairs.join(texts.select(F.col("node").alias(side), F.col("packed").alias(f"text_{side}")), side) for side in ("a", "b")
    )
    both = small_batches(one.join(two, ["a", "b"]))
    return both.mapInArrow(lambda rows: _linked(rows, k, num, den), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row of ``docs``: the components of the links ``den * intersection
    >= num * union`` between sets of word ``k``-grams (A-Z lower-cased)."""
    signed, named = _components_of_sets(docs, k, num, den, id_col, text)
    least = named.groupBy("top").agg(F.min("least").alias("component_id"))
    by_set = named.select("sid", "top").join(least, "top").select(F.col("sid").alias("set_id"), "component_id")
    rows = signed.select("id", F.col("n").alias("n_shingles"), "sid")
    out = rows.join(by_set, F.col("sid") == F.col("set_id"), "left")
    return out.select("id", "n_shingles", F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def without_near_duplicates(
    docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of ``docs`` of each component of ``near_duplicates`` and every row without words.

    The row with the smallest identifier stays, one with a null identifier only where all are null; of equal identifiers
    the digest of the text decides.
    """
    signed, named = _components_of_sets(docs, k, num, den, id_col, text)
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "digest")).alias("first")
    of_set = signed.where("sid IS NOT NULL").groupBy("sid").agg(first)
    of_top = of_set.join(named.select("sid", "top"), "sid").groupBy("top").agg(F.min("first").alias("first"))
    stays = of_top.select("first.id", "first.digest", F.lit(False).alias("wordless"))
    wordless = signed.where("sid IS NULL").select("id", "digest", F.lit(True).alias("wordless")).distinct()
    stays = _stored(stays.unionByName(wordless).withColumns(_named("id")).drop("id"), "stays")
    # Rows equal in identifier and text are copies of each other, unless they have no words. Both steps need rows dealt by the
    # same plain columns, so texts are shuffled once.
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.xxhash64(docs[text].cast("string")).alias("digest"),
        F.monotonically_increasing_id().alias("place"), docs[id_col].cast("long").alias("id"),
    )
    rows = rows.withColumns(_named("id")).drop("id").join(stays, ["known", "number", "digest"])
    rows = rows.withColumn("place", F.when(F.col("wordless"), F.col("place")))
    return rows.dropDuplicates(["known", "number", "digest", "place"]).select("row.*")


def _named(id_col: str) -> dict:
    """An identifier as two columns without nulls."""
    return {"known": F.col(id_col).isNotNull(), "number": F.coalesce(id_col, F.lit(0).cast("long"))}


def _components_of_sets(
    docs: DataFrame, k: int, num: int, den: int, id_col: str, text: str
) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, digest, n, sid, ...)`` and the sets ``(sid, least, top, ...)``; sets with the same ``top`` are a component."""
    source = docs.select(docs[id_col].cast("long").alias("id"), docs[text].cast("string").alias("text"))
    source = small_batches(source.withColumn("digest", F.xxhash64("text")))
    signed = source.mapInArrow(
        lambda rows: _signatures(rows, k, num, den),
        "id long, digest long, n long, sid binary, sketch binary, brief binary, spare_own int, spare_next int",
    )
    signed = _stored(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")

    # Equal sets are one node, named by one of its rows.
    nodes = signed.where("sid IS NOT NULL").groupBy("sid").agg(F.min("row").alias("node"), F.min("id").alias("least"))
    nodes = nodes.join(signed.drop("sid").withColumnRenamed("row", "node"), "node")
    nodes = _stored(nodes, "nodes")
    packed = source.mapInArrow(_packed, "text_id long, text_digest long, packed binary")
    same = F.col("id").eqNullSafe(F.col("text_id")) & (F.col("digest") == F.col("text_digest"))
    texts = _stored(nodes.select("node", "id", "digest").join(packed, same).select("node", "packed"), "node-texts")

    index = _shared_keys(texts, k, num, den)
    # Keys with the same entries are the same group: their label is made of the entries. Aggregated before the shuffle and
    # joined back, so that no task buffers all entries of a key.
    groups = index.groupBy("key").agg(
        F.expr("count(*) AS size"), F.expr("min(entry) AS low"), F.expr("max(entry) AS high"), F.expr("max(entry % 2) AS any_own"),
        F.expr("sum(xxhash64(entry) & 1073741823) AS mixed"),
    ).where("shiftright(low, 1) < shiftright(high, 1) AND any_own = 1")
    groups = groups.selectExpr("key", "size", "xxhash64(size, low, high, mixed) AS label")
    held = index.join(groups, "key")
    held = held.selectExpr("shiftright(entry, 1) AS node", "entry % 2 = 1 AS own", "size", "label AS key")
    held = _stored(held, "shared-keys")
    spare = nodes.select("node", "spare_own", "spare_next")
    full = held.where(F.col("size") > HOT).groupBy("node", "own").count().join(spare, "node")
    full = full.where(F.col("count") > F.when(F.col("own"), F.col("spare_own")).otherwise(F.col("spare_next")))
    warm = held.where(F.col("size") > HOT).join(full.select("node", "own"), ["node", "own"], "left_semi")
    left_in = held.where(F.col("size") <= HOT).unionByName(warm.select(held.columns)).distinct()
    left_in = _stored(left_in.select("key", "node", "own").join(nodes.select("node", "n"), "node"), "kept-entries")
    rest = left_in.groupBy("key").agg(
        F.count("*").alias("size"), F.count(F.when(F.col("own"), 1)).alias("owners"), F.max("n").alias("most")
    )
    shared = left_in.join(rest.where("size > 1 AND owners > 0").select("key", "size", "most"), "key")
    shared = _stored(shared, "kept-keys")

    labels = _stored(shared.select("node").distinct().withColumn("root", F.col("node")), "labels")
    # Only nodes in groups need their sketches again, on their way to pairs and groups.
    sketches = _stored(nodes.select("node", "n", "sketch", "brief").join(labels, "node", "left_semi"), "sketches")

    def joined(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Labels after the links among ``pairs``."""
        links = _stored(_verify(pairs, sketches, texts, k, num, den), "links")
        ends = links.join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        ends = ends.join(labels.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        tops = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).selectExpr("root AS top", "node AS root")
        return _stored(labels.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")

    def opened(labels: DataFrame) -> DataFrame:
        """Entries of groups that still hold several components."""
        entries = shared.join(labels, "node")
        mixed = entries.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
        return entries.join(mixed, "key", "left_semi")

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    for turn in range(HUB_ROUNDS):
        entries = opened(labels)
        # Hot groups offer another hub each turn; of the others a node takes one hub. All groups draw in the same order, so those
        # with many nodes in common offer few hubs, and a node meets few. A hub of another size cannot link.
        draw = F.when(F.col("own"), F.xxhash64("node", F.lit(turn)))
        hubs = entries.groupBy("key").agg(F.min_by(F.struct("node", "n", "root"), draw).alias("at"))
        hubs = hubs.select("key", F.col("at.node").alias("hub"), F.col("at.n").alias("hub_n"), F.col("at.root").alias("hub_root"))
        met = entries.join(hubs, "key").where("root <> hub_root")
        met = met.where(F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num)
        one = met.where(F.col("size") <= HOT).groupBy("node").agg(F.min("hub").alias("hub"))
        pairs = one.union(met.where(F.col("size") > HOT).select("node", "hub")).select(*ordered("node", "hub")).distinct()
        labels = joined(pairs, labels)

    # Pairs across the components that are left in a group. Groups come in parts of bounded size, and parts meet in
    # pairs; only pairs whose sketches are near enough leave the task. The pairs of a group grow with the square of its size, so
    # hot groups hold whole sketches, which let hardly any but links through; brief ones serve groups of at most ``HOT`` nodes.
    hot = F.col("size") > HOT
    parts = F.ceil(F.col("size") * (F.when(hot, F.col("most")).otherwise(F.col("most") / 4) + 64) / F.lit(PART_BYTES))
    held = F.when(hot, F.col("sketch")).otherwise(F.col("brief")).alias("held")
    entries = opened(labels).join(sketches.drop("n"), "node").select("key", "size", "most", "node", "root", "own", "n", held)
    entries = entries.withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    entries = entries.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), F.struct("part", "node", "root", "own", "n", "held").alias("e"))
    groups = small_batches(entries.groupBy("key", "low", "high").agg(F.collect_list("e").alias("m")))
    near = groups.mapInArrow(lambda rows: _near_in_group(rows, num, den), "a long, b long").distinct()
    labels = joined(near, labels)

    return signed, nodes.join(labels, "node", "left").withColumn("top", F.coalesce("root", "node"))
