"""Queries of the training-data operators over the given tables, each with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import (
    alignment, compression, contamination, html_crf, langid, mips, mixing, neardup, pieces, quality_fm, runs, tokens, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@_query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select(
        "doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")
    )
    counted = tokens.token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


@_query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    scored = quality_fm.quality_scores(docs, labels, keep=["doc_id"])
    return scored.select("doc_id", quality_fm.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op8_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return compression.compression_rules(_table(spark, folder, "documents"), keep=["doc_id"])


@_query
def op9_parity_sketch_join(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@_query
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], with_texts=False)


@_query
def op1_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses_from_pages(_table(spark, folder, "pages")))


@_query
def op4_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.temperature_mix(_table(spark, folder, "documents"), mixing.Target(0.95, 4.0, 1.0), keep=["doc_id"])
    return mixed.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("source", "tokens", "weight", "epoch", "block", "place")])


@_query
def op5_language_fusion(spark: SparkSession, folder: str) -> DataFrame:
    model = langid.train(_table(spark, folder, "documents"))
    return langid.identify(_table(spark, folder, "pages"), model)


@_query
def op6_norm_bucketed_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return mips.top_products(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op6_norm_bucketed_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@_query
def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    return html_crf.extract_main_text(pages, html_crf.train(pages), keep=["page_id", "url"])


@_query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.periodic_runs(with_planted_periods(_table(spark, folder, "documents")), keep=["doc_id"], with_texts=False)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` with a period written into one text of ten: by its CRC-32 ``h``, words from ``a`` on repeat the ``p`` words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    period = F.slice(words, a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), 1, n - a)
    planted = F.array_join(F.concat(F.slice(words, 1, a), tail), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & (n > 0), planted).otherwise(F.col("text")))


@_query
def op12_tokenizer_alignment(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(_table(spark, folder, "documents"), a, b, keep=["doc_id"], with_links=False)


@_query
def op13_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hits = contamination.benchmark_hits(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), keep=["doc_id"])
    return hits.drop("spans", "items")


ORACLES["op13_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), i AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, list_slice(w, k, k + least(len(w), 10) - 1) AS gram
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0)
), s AS (
  SELECT r, m, k, list_slice(w, k, k + m - 1) AS gram
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)
), h AS (SELECT s.r, s.k, s.m, i.item FROM s JOIN i ON s.gram = i.gram),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + m)) AS q FROM h) GROUP BY r),
t AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
"""
