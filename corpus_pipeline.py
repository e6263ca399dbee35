"""A training corpus from raw documents: each stage's result is written, read again and is the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from riskspark.llm import compression, mixing, neardup, pieces, quality_fm
from riskspark.session import scratch_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the factorisation machine scores at 0.7 or more."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return quality_fm.quality_scores(docs, labels).where("score >= 0.7").select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the base rule and the compression bands keep."""
    return compression.compression_rules(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a Jaccard similarity of 0.8 or more.

    The document with the component's smallest identifier stays, and with it every document without words.
    """
    return neardup.without_near_duplicates(docs, k=5, num=8, den=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by flattened weights: no document is lost, small sources are repeated up to twice."""
    return mixing.temperature_mix(docs, mixing.Target(entropy=0.9, repetition=2.0, budget=None)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with their digests and those of the decoded text."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "source"]).drop("decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("temperature_mixing", mix_sources),
    ("sentencepiece", encode),
]

# The classifier, the compression bands and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
