"""Benchmark decontamination with built-in functions only: windows of benchmark items found in training texts.

Words are runs of digits, letters a-z after A-Z have been lowered, and characters beyond ASCII. A window is ``size``
consecutive words of an item; an item with fewer words, but not none, is one window. The distinct windows are a hash set:
their 64-bit hashes are broadcast with the windows. Each training text is split once, the hash of each of its windows is
looked up, and a hit counts only if the words are the same (the join's condition, evaluated on hash matches alone).

Scale: of a text nothing but its hits and one small row leave the scan; they are grouped by a hash of the row, with partial
aggregates. Items travel as numbers of sets: all windows with the same items share one. The set is measured before it
is broadcast; beyond ``BROADCAST_BYTES`` it is dealt into parts by hash and the texts are scanned once a part.

Defined results: null, empty and wordless texts have no words and no hit. An item without identifier marks words but is not
listed. Equal windows of many items, and items with equal identifiers, count once. Equal rows keep their number. No items:
nothing is hit. A kept column that has the name of a result gives way.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.session import fits_broadcast, scratch_path

BROADCAST_BYTES = 32 << 20
# Copies of equal rows that one task puts out again.
COPIES = 4096
# What stands between words, once A-Z have been lowered, and where a word ends in a text as it is.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD_END = r"(?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?=[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEYS = ["key", "key2"]


def words(text: Column) -> Column:
    """Normalised words of a text, in order."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def item_windows(items: DataFrame, size: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``gram`` (its words), ``width``, their ``hash``, and the sorted ``items`` that hold it."""
    split = items.select(items[item_id].cast("string").alias("item"), words(items[text]).alias("words")).where(F.size("words") > 0)
    width = F.least(F.size("words"), F.lit(size))
    starts = split.select("item", "words", width.alias("width"), F.explode(F.sequence(F.lit(1), F.size("words") - width + 1)).alias("at"))
    grams = starts.select("item", "width", F.slice("words", F.col("at"), F.col("width")).alias("gram"))
    found = grams.groupBy("gram", "width").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return found.withColumn("hash", F.xxhash64("gram"))


def _row_key(docs: DataFrame, columns: list[str]) -> list[Column]:
    """96 bits of hash over the columns: equal for equal rows only."""
    plain = [F.to_json(F.struct(docs[c])) if "map<" in t else docs[c] for c, t in docs.dtypes if c in columns]
    plain = [F.struct(F.isnull(c), c) for c in plain]
    return [F.xxhash64(*plain).alias("key"), F.hash(*plain).alias("key2")]


def _place(widths: list[int]) -> tuple[Column, Column]:
    """First word (from 1) and width of the ``p``-th window of a text, windows listed width by width."""
    before, cases = F.lit(0), []
    for width in widths:
        windows = F.greatest(F.col("n") - width + 1, F.lit(0))
        cases.append((F.col("p") <= before + windows, F.col("p") - before, width))
        before = before + windows
    start, wide = cases[-1][1], F.lit(cases[-1][2])
    for here, at, width in reversed(cases[:-1]):
        start, wide = F.when(here, at).otherwise(start), F.when(here, width).otherwise(wide)
    return start, wide


def _scan(split: DataFrame, widths: list[int], windows: DataFrame | None, with_rows: bool) -> DataFrame:
    """One row for each text, without ``at``, and one for each hit: first word ``at``, ``wide`` words, set of items ``listed``."""

    def hashes_of(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.col("n") - width + 1)
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, width)))
        return F.when(F.col("n") >= width, hashes).otherwise(F.array().cast("array<bigint>"))

    hashes = [hashes_of(w) for w in widths]
    # The text itself is the first entry. An outer generator, as for others the filter on their size would compute all twice.
    listed = split.withColumn("hashes", F.concat(F.array(F.lit(None).cast("long")), *hashes))
    each = listed.select(*_KEYS, "kept", "words", "n", F.posexplode_outer("hashes").alias("p", "hash"))
    if windows is None:
        return each.select(*_KEYS, "kept", "n", *[F.lit(None).cast(t).alias(c) for c, t in (("at", "int"), ("wide", "int"), ("listed", "string"))])
    start, wide = _place(widths)
    here = F.slice(each["words"], start, wide)
    # Not written as an equality: that would be a join key, made for every window instead of for those whose hash is met.
    same = (each["hash"] == windows["hash"]) & (here >= windows["gram"]) & (here <= windows["gram"])
    met = each.join(F.broadcast(windows), same, "left")
    met = met.where(F.col("listed").isNotNull() | (F.col("p") == 0) if with_rows else F.col("listed").isNotNull())
    own = F.col("p") == 0
    return met.select(
        *_KEYS, F.when(own, F.col("kept")).alias("kept"), "n", F.when(~own, start).alias("at"), F.when(~own, wide).alias("wide"), "listed"
    )


def _found(docs: DataFrame, items: DataFrame, size: int, text: str, keep: list[str], item_id: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Per distinct row: ``kept`` columns, number of equal rows, words, numbers of hit words, sets of items; and these sets."""
    spark = docs.sparkSession
    listed = item_windows(items, size, item_id, item_text).withColumn("listed", F.sha2(F.to_json("items"), 256))
    stored = scratch_path(spark, "benchmark-windows")
    listed.write.parquet(stored)
    listed = spark.read.parquet(stored)
    bytes_ = F.sum(F.octet_length(F.array_join("gram", " ")) + 16 * F.size("gram") + 128)
    measured = listed.agg(F.coalesce(bytes_, F.lit(0)).alias("bytes"), F.array_sort(F.collect_set("width")).alias("widths")).first()
    parts = max(1, math.ceil(measured.bytes / BROADCAST_BYTES))

    split = docs.select(*_row_key(docs, [*keep, text]), F.struct(F.lit(0).alias("none"), *[docs[c] for c in keep]).alias("kept"), words(docs[text]).alias("words"))
    split = split.withColumn("n", F.size("words"))
    windows = listed.select("hash", "gram", "listed")
    scans = [
        _scan(split, measured.widths, windows.where(F.pmod("hash", F.lit(parts)) == part) if measured.widths else None, part == 0)
        for part in range(parts)
    ]
    hit_words = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h.at, h.at + h.wide - 1)))))
    found = (
        reduce(DataFrame.unionByName, scans)
        .groupBy(*_KEYS)
        .agg(
            F.first("kept", ignorenulls=True).alias("kept"), F.count("kept").alias("copies"), F.max("n").cast("long").alias("n_words"),
            F.collect_set(F.when(F.col("at").isNotNull(), F.struct("at", "wide"))).alias("hits"), F.collect_set("listed").alias("sets"),
        )
        .select(*_KEYS, "kept", "copies", "n_words", "sets", hit_words.alias("hit"))
    )
    # Read several times below, and small: a row for each text.
    stored = scratch_path(spark, "benchmark-hits")
    found.write.parquet(stored)
    return spark.read.parquet(stored), listed.select("listed", "items").dropDuplicates(["listed"])


def _spans() -> Column:
    """Stretches of hit words: ``start`` (from 0) and ``length``."""
    hit = F.col("hit")
    starts = F.filter(hit, lambda w, i: (i == 0) | (F.get(hit, i - 1) != w - 1))
    ends = F.filter(hit, lambda w, i: (i == F.size(hit) - 1) | (F.get(hit, i + 1) != w + 1))
    return F.zip_with(starts, ends, lambda s, e: F.struct((s - 1).cast("long").alias("start"), (e - s + 1).cast("long").alias("length")))


def _again(rows: DataFrame) -> DataFrame:
    """Every row as often as it was there; very many copies are spread before they are put out."""
    few = rows.where(F.col("copies") <= COPIES).withColumn("part", F.lit(1).cast("long"))
    many = rows.where(F.col("copies") > COPIES)
    many = many.withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("copies") / COPIES)))).repartition(*_KEYS, "part")
    left = F.least(F.lit(COPIES), F.col("copies") - (F.col("part") - 1) * COPIES)
    return few.unionByName(many).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))


_RESULT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items"]


def benchmark_hits(
    docs: DataFrame, items: DataFrame, size: int = 10, text: str = "text", keep: list[str] | None = None,
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` (columns ``keep``, default all but the text) with ``n_words, n_hit, n_items``, the SHA-256 of the sorted item
    identifiers joined by commas, ``contaminated``, the hit ``spans`` (first word from 0, words) and the ``items``.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in _RESULT and (keep is not None or c != text)]
    found, sets = _found(docs, items, size, text, keep, item_id, item_text)
    per_set = found.where(F.size("sets") > 0).select(*_KEYS, F.explode("sets").alias("listed")).join(sets, "listed")
    per_row = per_set.groupBy(*_KEYS).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    rows = found.join(per_row, _KEYS, "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    rows = rows.select(
        *_KEYS, "copies", "kept", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), _spans().alias("spans"), "items",
    )
    return _again(rows).select(*[F.col("kept")[c].alias(c) for c in keep], *_RESULT)


def decontaminate(
    docs: DataFrame, items: DataFrame, remove: str = "documents", size: int = 10, text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """``docs`` without the documents that hold a window, or (``remove="spans"``) without the hit words of their texts.

    A hit word goes with what stands between it and the word before; a text without hits stays byte for byte.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is documents or spans")
    found, _ = _found(docs, items, size, text, list(docs.columns), item_id, item_text)
    hit = found.where(F.size("hit") > 0).select(*[F.col(c).alias(f"hit_{c}") for c in _KEYS], _spans().alias("spans"))
    hit = F.broadcast(hit) if fits_broadcast(hit) else hit
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_row_key(docs, list(docs.columns)))
    same = (F.col("key") == F.col("hit_key")) & (F.col("key2") == F.col("hit_key2"))
    if remove == "documents":
        return whole.join(hit, same, "left_anti").select("row.*")
    joined = whole.join(hit, same, "left")
    body = F.col("row")[text].cast("string")
    # Each word with what stands before it, and what stands behind the last one.
    pieces = F.split(body, _WORD_END)
    joined = joined.withColumn("pieces", F.when(F.col("spans").isNotNull(), pieces))
    spans, n = F.col("spans"), F.size("pieces")
    gap_end = lambda i: F.coalesce(F.get(spans, i).start, n)
    gap_begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1).start + F.get(spans, i - 1).length)
    kept = F.transform(
        F.sequence(F.lit(0), F.size(spans)),
        lambda i: F.array_join(F.slice(F.col("pieces"), (gap_begin(i) + 1).cast("int"), (gap_end(i) - gap_begin(i)).cast("int")), ""),
    )
    cleaned = F.when(spans.isNotNull(), F.array_join(kept, "")).otherwise(F.col("row")[text])
    return joined.select(*[cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
