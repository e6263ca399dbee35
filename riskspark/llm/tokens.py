"""Token counts through a digest cache.

A count depends on the normalised text and on the tokenizer only, so it is stored under the digests of both. A run
looks all digests up in the cache (digests alone are shuffled for that), fetches one text for each digest that is
missing, encodes these and appends the counts to the cache; then every row takes its count from the cache.

Normalised means: runs of the six ASCII white space characters become one space, at the ends none. That holds for
tokenizers that drop white space between words; for any other the text itself is digested and encoded whole.

Recovery: the cache is a Parquet folder that is only ever appended to by whole committed files. If a run dies
between encoding and use, a later one finds the counts. Two runs may append the same digest; readers keep one.

Defined results: null counts as empty, the empty text has no tokens; equal rows keep their number.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm.kept import kept_apart
from riskspark.llm.textbytes import small_batches
from riskspark.session import scratch_path

CACHE_SCHEMA = "version string, digest binary, n_tokens long"
# Words a worker remembers between texts; beyond it starts over (memory, not results).
REMEMBERED_WORDS = 1_000_000


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file never shares counts."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def drops_space(path: str) -> bool:
    """Whether the tokenizer cuts words by the one pattern known here, which drops all white space."""
    with open(path, encoding="utf-8") as file:
        cutter = (json.load(file).get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return cutter[0].get("pattern") == {"Regex": PATTERN} and cutter[0].get("invert") is True


def normalised(text, space: bool = True):
    if not space:
        return F.coalesce(text.cast("string"), F.lit(""))
    return F.btrim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]+", " "))


def digest(text, space: bool = True):
    """First 16 bytes of the SHA-256 of the normalised text."""
    return F.unhex(F.substring(F.sha2(F.encode(normalised(text, space), "UTF-8"), 256), 1, 32))


# The tokenizer's pattern for words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# What that pattern cuts a lower-cased word of plain ASCII into; there \\p{L} is a-z and \\p{N} is 0-9 (fixed value).
_PARTS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_PLAIN = re.compile(rb"[!-~]+")


@lru_cache(maxsize=2)
def word_counts(path: str):
    """A function that counts tokens of a list of texts word by word.

    The tokenizer never joins characters across white space, so a text has as many tokens as its words together;
    each distinct word is looked at once. Plain ASCII words are cut into the parts the tokenizer's pattern gives and
    each distinct part goes to the library's model (bytes 33 to 126 stand for themselves there); all others, and words
    that may hold a special string, go through the whole library.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if not drops_space(path):
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    merge = tokenizer.model.tokenize
    known: dict[bytes, int] = {}
    parts: dict[bytes, int] = {}

    def part_count(part: bytes) -> int:
        found = parts.get(part)
        if found is None:
            if len(parts) >= REMEMBERED_WORDS:
                parts.clear()
            found = parts[part] = len(merge(part.decode()))
        return found

    def count(texts: list[str | None]) -> list[int]:
        out = []
        for text in texts:
            words = (text or "").encode().split()
            new = set(words).difference(known)
            if len(known) + len(new) > REMEMBERED_WORDS:
                known.clear()
                new = set(words)
            plain = [w for w in new if _PLAIN.fullmatch(w) and b"<|" not in w]
            for word in plain:
                known[word] = sum(map(part_count, _PARTS.findall(word.lower())))
            rest = list(new.difference(plain))
            for at in range(0, len(rest), 5000):
                some = rest[at : at + 5000]
                for word, found in zip(some, tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False), strict=True):
                    known[word] = len(found)
            out.append(sum(map(known.__getitem__, words)))
        return out

    return count


def _encode(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    count = word_counts(path)
    for batch in rows:
        counts = [count([x.as_py()])[0] for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])


def read_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """``(digest, n_tokens)`` of one tokenizer, one row per digest; an empty cache has none."""
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


@kept_apart()
def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs`` (columns ``keep``, default all) with ``n_tokens``; a column of that name gives way.

    ``cache_path``: a folder all executors reach, kept between runs; by default a fresh one in the shared folder.
    The tokenizer file must be at ``tokenizer_path`` on every executor.
    """
    spark = docs.sparkSession
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version, space = tokenizer_version(tokenizer_path), drops_space(tokenizer_path)
    keep = [c for c in (docs.columns if keep is None else keep) if c != "n_tokens"]
    keyed = docs.select(docs[text].alias("__text"), digest(docs[text], space).alias("digest"))

    stored = read_cache(spark, cache_path, version)
    missing_path = scratch_path(spark, "token-misses")
    keyed.select("digest").distinct().join(stored, "digest", "left_anti").write.parquet(missing_path)
    missing = spark.read.schema("digest binary").parquet(missing_path)
    # One text per digest, combined before the shuffle, so a text that fills a third of all rows is one row per task.
    # Spark moves this semi join below the aggregation when the misses are few, and then no text is shuffled for hits.
    one_each = keyed.groupBy("digest").agg(F.min("__text").alias("text")).join(missing, "digest", "left_semi")
    counted = small_batches(one_each).mapInArrow(lambda rows: _encode(rows, tokenizer_path), "digest binary, n_tokens long")
    counted.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)

    found = read_cache(spark, cache_path, version).withColumnRenamed("digest", "__digest").withColumnRenamed("n_tokens", "__n")
    rows = docs.select(*[docs[c] for c in keep], digest(docs[text], space).alias("__key"))
    return rows.join(found, F.col("__key") == F.col("__digest"), "left").select(*[rows[c] for c in keep], F.col("__n").alias("n_tokens"))
